"""Publication of an index: a new version beside the old one, checked by reading it back, then a pointer moved to it.

    path/versions/V/table      the tables of a version, V its name
    path/pointers/N            one row: the version that readers take, the time, counts; the highest N counts

A reader that comes between two writes, or after a crash, finds the last pointer and its whole version. Old versions stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import etl
from lattiq.sources.readers import read_json

POINTER = "n long, folder string, version string, counts map<string,bigint>, built_at timestamp"
#: The tables whose ids and names the version stands for.
NAMED = ["groups", "branches", "teams", "players"]


class Unfaithful(Exception):
    """What was read back isn't what was to be written."""


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """All pointers of a publication, none for a path without one."""
    return read_json(spark, f"{path}/pointers/*", POINTER, lines=True).where("n IS NOT NULL")


def last_pointer(spark: SparkSession, path: str):
    """The pointer that readers follow, or None."""
    return pointers(spark, path).orderBy(F.desc("n")).first()


def content(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, print): the number of rows of each table and a hash of them all in any order."""
    parts = []
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
        parts.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("print")))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def publish(tables: dict[str, DataFrame], path: str, built_at: Column | None = None) -> str:
    """Write the tables of etl.build_index() as a new version and move the pointer to it; gives the version's folder.

    Each table is read back and must have the rows, and all in all the content, that were to be written; else the pointer stays.
    """
    spark = next(iter(tables.values())).sparkSession
    own = {k: v for k, v in tables.items() if k not in ("version", "counts")}
    before = last_pointer(spark, path)
    folder = f"versions/{uuid.uuid4().hex}"
    for name, df in own.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    written = {name: spark.read.parquet(f"{path}/{folder}/{name}") for name in own}
    wanted = {r.name: (r.n, r.print) for r in content(own).collect()}
    found = {r.name: (r.n, r.print) for r in content(written).collect()}
    if wanted != found:
        raise Unfaithful(f"{path}/{folder}: " + ", ".join(k for k in wanted if wanted[k] != found[k]))
    names = [written[t].select("id", "name") for t in NAMED if t in written]
    every = names[0]
    for more in names[1:]:
        every = every.unionByName(more)
    pointer = etl.index_version(every).select(
        F.lit((before.n if before else 0) + 1).cast("long").alias("n"),
        F.lit(folder).alias("folder"),
        "version",
        F.create_map(*[F.lit(x) for k, (n, _) in found.items() for x in (k, n)]).cast("map<string,bigint>").alias("counts"),
        (F.current_timestamp() if built_at is None else built_at).alias("built_at"),
    )
    pointer.coalesce(1).write.json(f"{path}/pointers/{(before.n if before else 0) + 1:012d}")  # fails if another publication took the number
    return folder


def read_index(spark: SparkSession, path: str, n: int | None = None) -> dict[str, DataFrame]:
    """The tables of the version that the last pointer names (or pointer ``n``); without a pointer none."""
    pointer = last_pointer(spark, path) if n is None else pointers(spark, path).where(F.col("n") == n).first()
    return {} if pointer is None else {name: spark.read.parquet(f"{path}/{pointer.folder}/{name}") for name in pointer.counts}
