"""What the corpus operators share: reading tables, Arrow batches, checkpoints, word splitting."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text whose A-Z were lower-cased: runs of digits, a-z and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows of an Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer partitions than there are cores (one small file) dealt out over the cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a Python worker holds few whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; one is made only where none is named and driver and executors are one process, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattiq-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The rows written to the shared checkpoint folder: short lineage that outlives an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


#: Bits of a key filter for each key, of one of its blocks, and its most blocks (64 MB in all).
KEY_BITS, BLOCK_BITS, MOST_BLOCKS = 16, 32768, 16384


def split_by_keys(rows: DataFrame, own: Column, keys: DataFrame, theirs: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash may be among the keys', rows whose hash is not); keys are written already.

    The keys' hashes become bits of blocks, which are broadcast: at most 64 MB, whatever the number of keys. With more keys than bits the
    first part holds more rows than it need, never fewer, so that an exact join of it alone is right. It moves few
    of the texts where few have a key.
    """
    blocks = min(max(1, -(-keys.count() * KEY_BITS // BLOCK_BITS)), MOST_BLOCKS)
    place = lambda hashed: F.pmod(hashed, F.lit(blocks * BLOCK_BITS))
    bits = keys.select(place(theirs).alias("at")).select(F.bitmap_bucket_number("at").alias("__block"), F.bitmap_bit_position("at").alias("bit"))
    bits = cut(bits.repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("bit").alias("__bits")))
    at = F.bitmap_bit_position(place(own))
    marked = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place(own)) == bits["__block"], "left")
    byte = F.conv(F.hex(F.substring(bits["__bits"], (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    columns = [rows[f"`{c}`"] for c in rows.columns]
    return marked.where(hit).select(*columns), marked.where(~hit).select(*columns)


def map_columns(
    df: DataFrame,
    inputs: list[str],
    keep: list[str],
    added: T.StructType,
    make: Callable[[], Callable[..., list[tuple]]],
    keep_row: bool = False,
) -> DataFrame:
    """Append columns that a Python function computes from whole Arrow batches.

    ``make()`` runs once for each task and returns a function from the lists of the ``inputs`` columns
    to one tuple per row. ``keep`` columns are passed on as they are. With ``keep_row`` the
    function returns booleans instead, and only the rows with True are passed on.
    """
    small_batches(df.sparkSession)
    names = list(dict.fromkeys([*inputs, *keep]))
    # columns travel by place, as a name may hold a dot or be one of the added ones
    source = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    read, passed = [names.index(c) for c in inputs], [names.index(c) for c in keep]
    kept = [T.StructField(f"k{k}", source.schema[at].dataType) for k, at in enumerate(passed)]
    new = [] if keep_row else [T.StructField(f"n{k}", f.dataType) for k, f in enumerate(added.fields)]
    arrow_new = _arrow(T.StructType(new))
    titles = [f.name for f in kept + new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = function(*[batch.column(at).to_pylist() for at in read])
            arrays = [batch.column(at) for at in passed]
            if keep_row:
                yield pa.RecordBatch.from_arrays(arrays, names=titles).filter(pa.array(rows, pa.bool_()))
                continue
            for k, field in enumerate(arrow_new):
                arrays.append(pa.array([r[k] for r in rows], field.type))
            yield pa.RecordBatch.from_arrays(arrays, names=titles)

    return source.mapInArrow(run, T.StructType(kept + new)).toDF(*keep, *([] if keep_row else added.names))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def words(text: str | None) -> list[str]:
    """The words of a text; A-Z lower-cased first. Null has none."""
    return WORD.findall(text.translate(_LOWER)) if text else []


class WordHashes(dict):
    """64-bit hash of each word, the same in every process; cleared when it has grown large."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from their hashes; empty if there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        total += hashes[j : j + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total
