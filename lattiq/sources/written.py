"""Written stages: checkpoints in the folder that executors share, and builds of named tables that go on where they stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; one is made only where none is named and driver and executors are one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattiq-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that plans stay small and a lost executor costs little."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def whole(df: DataFrame) -> DataFrame:
    """A table that grows with the catalog, as a side of a join that must not be broadcast: the planner goes by the size of compressed files, and what it broadcasts passes the driver at several times that."""
    return df.hint("merge")


#: Counted rows up to which few() has a table broadcast.
BROADCAST_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if its counted rows are few; rows are read from what is written."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Build:
    """Named tables written to a folder, one after the other, with a record of each one that is done.

    A table counts as done once its record stands, which is written after its rows were read back and counted. A second build in the same folder
    with the same ``inputs`` (any text that tells its inputs from others) takes up done tables as they are, up to the first that isn't; that one and
    all after it are made anew, as they may read what has changed.
    """

    RECORD = "name string, inputs string, n long"

    def __init__(self, spark: SparkSession, folder: str, inputs: str = ""):
        self.spark, self.folder, self.inputs = spark, folder, inputs
        self.made: list[str] = []

    def records(self) -> dict[str, tuple[str, int]]:
        """(inputs, rows) of each done table."""
        from lattiq.sources.readers import read_json

        return {r.name: (r.inputs, r.n) for r in read_json(self.spark, f"{self.folder}/done/*", self.RECORD, lines=True).collect()}

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a name; made only if it, or one before it, wasn't done."""
        where = f"{self.folder}/{name}"
        if self.made or self.records().get(name, (None,))[0] != self.inputs:
            self.made.append(name)
            make().write.mode("overwrite").parquet(where)
            written = self.spark.read.parquet(where)
            record = written.agg(F.lit(name).alias("name"), F.lit(self.inputs).alias("inputs"), F.count("*").alias("n"))
            record.write.mode("overwrite").json(f"{self.folder}/done/{name}")
        return self.spark.read.parquet(where)
