"""Streams: the first sight of each key as keyed state, and prepare by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

#: Keyed state of any size needs a store that keeps it on disk.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A run ends when its files are read; state by the clock would have it go on with empty batches.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


class FirstSight(StatefulProcessor):
    """Lets a key's first row through, with the least time among its rows of that batch, and no other until the key is forgotten."""

    def __init__(self, key: str, time: str, forget: int | None):
        self.key, self.time, self.forget = key, time, forget

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]), self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = min((t for t in (part[self.time].min() for part in rows) if pd.notna(t)), default=pd.NaT)
        if not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame({self.key: [key[0]], self.time: pd.to_datetime([first])})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, key: str = "url", time: str = "ts", forget_ms: int | None = None) -> DataFrame:
    """(key, time): each key of a stream once, when it is first seen; late rows are no exception, as nothing depends on a watermark.

    A key's state lasts until it was not written for ``forget_ms``, or for good.
    The query must be started within :func:`disk_state`.
    """
    kinds = {f.name: f for f in events.schema.fields}
    return events.select(key, time).groupBy(key).transformWithStateInPandas(
        statefulProcessor=FirstSight(key, time, forget_ms), outputStructType=StructType([kinds[key], StructField(time, kinds[time].dataType)]),
        outputMode="Append", timeMode="None" if forget_ms is None else "ProcessingTime",
    )


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in this block keep their state on disk and make no empty batches."""
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, EMPTY_BATCHES)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def record_first_sights(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str = "url", time: str = "ts", forget_ms: int | None = None) -> None:
    """The rows of new files under ``source`` are read, and keys not seen before are appended to ``out``.

    A run goes on from ``checkpoint``, where the files read and the keys seen are
    kept; a batch that is run again replaces what it wrote.
    """

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with disk_state(spark):
        stream = first_seen(spark.readStream.schema(schema).parquet(source), key, time, forget_ms)
        query = stream.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def counts(events: DataFrame, time: str = "ts", window: str = "1 day", delay: str = "1 day", by: str = "event_type") -> DataFrame:
    """(start, by, n) of tumbling windows; late rows within the delay count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in micro-batches, then stop.  ``each`` must be repeatable by batch id."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_parquet(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
