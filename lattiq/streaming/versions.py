"""The newest version of each event from a stream that delivers late, twice and out of order; and answers that are written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: States after which an event changes no more.
FINISHED = ["FINISHED", "CANCELLED"]
#: How long a finished event is remembered after its end, in milliseconds, so that late rows of it are known to be old.
KEEP_MS = 6 * 3600 * 1000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestVersion(StatefulProcessor):
    """Passes a row on if its version is newer than any seen of its event; of equal versions in one batch the largest payload.

    The state of an event is its last version alone. A finished event sets a timer, which drops the state; a row that arrives after that
    is older than the watermark, and is dropped before it comes here.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last = held[0] if held is not None else None
        best = None
        for batch in rows:
            new = batch if last is None else batch[batch["version"] > last]
            new = new if best is None else pd.concat([best, new])
            if len(new):
                best = new.sort_values(["version", "payload"], na_position="first").tail(1)
        if best is None:
            return
        self.last.update((int(best["version"].iloc[0]),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if best["state"].iloc[0] in FINISHED:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(best["at"].iloc[0].timestamp() * 1000)) + self.keep_ms)
        yield best[["event_id", "version", "state", "payload", "at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def newest_versions(rows: DataFrame, late: str = "1 hour", keep_ms: int = KEEP_MS) -> DataFrame:
    """Of a stream rows(event_id, version, state, payload, at) those that are newer than what was passed on of their event before.

    ``at`` is when the source made the row; rows later than ``late`` behind the watermark are dropped. The session needs PROVIDER as its state store.
    """
    own = rows.select(F.col("event_id").cast("long"), F.col("version").cast("long"), "state", "payload", "at").where("event_id IS NOT NULL AND version IS NOT NULL AND at IS NOT NULL")
    schema = "event_id long, version long, state string, payload string, at timestamp"
    marked = own.withWatermark("at", late)
    return marked.groupBy("event_id").transformWithStateInPandas(NewestVersion(keep_ms), StructType.fromDDL(schema), "Update", "EventTime")


def read_versions(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of the versions in a folder of JSON lines; of a row that isn't one there is no row."""
    reader = spark.readStream.schema("event_id long, version long, state string, payload string, at timestamp")
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).json(path)


def write_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches in which a batch that comes again, after a crash between its rows and its commit, replaces itself.

    Each batch has a folder of its own, ``batch=N``, that it overwrites whole; ``key`` counts once in a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    """The row of each key from the last batch that holds it."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("row")).select(key, "row.*").drop("batch")


def follow(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query in update mode that hands each micro-batch and its number to ``write``, and takes up again from its checkpoint."""
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()
