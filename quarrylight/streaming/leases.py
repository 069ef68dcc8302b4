"""The periodic work as Structured Streaming: what is there is worked off, then the query ends.

State tables stay immutable snapshots: a micro-batch reads the current one,
applies the batch's events once, and publishes the next by its number, so that a
batch that is run again after a failure writes the same snapshot again.  Which
numbers a stream writes is settled when its checkpoint folder is first used and
written beside the snapshots: a new checkpoint folder goes on after the last
snapshot and never writes over one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.state import transition


def snapshot(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={number}")


def latest(spark: SparkSession, folder: str) -> int:
    """The last snapshot's number."""
    found = spark.read.parquet(folder).select(F.max("v")).first()[0]
    return int(found)


def base_of(spark: SparkSession, folder: str, checkpoint: str) -> int:
    """The snapshot that a stream with this checkpoint folder starts from: the last one when it was first seen."""
    runs = f"{folder}-runs"
    path = spark._jvm.org.apache.hadoop.fs.Path(runs)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.parquet(runs).where(F.col("checkpoint") == checkpoint).agg(F.min("base")).first()[0]
        if known is not None:
            return int(known)
    base = latest(spark, folder)
    spark.createDataFrame([(checkpoint, base)], "checkpoint string, base long").coalesce(1).write.mode("append").parquet(runs)
    return base


def work_off(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame, DataFrame], DataFrame] | None = None, deadline: float | None = None) -> int:
    """Apply a stream of (url, event) to the snapshots in `folder` (v=0 is the first); returns the last number.

    A URL with several events in a batch takes the last by `at`.  After
    `deadline` seconds no further batch begins: the rest waits for the next run.
    The number of documents in a batch is bounded by the source's own limits.
    """
    apply = step or (lambda state, batch: transition(state, batch, recheck="recheck", retry="retry", missing="missing"))
    base, end = base_of(spark, folder, checkpoint), None if deadline is None else time.monotonic() + deadline
    last = [latest(spark, folder)]

    def publish(batch: DataFrame, epoch: int) -> None:
        if end is not None and time.monotonic() > end:
            raise TimeoutError("the run's deadline")
        one = batch.groupBy("url").agg(F.max_by("event", "at").alias("event"))
        number = base + epoch + 1
        if last[0] > number:
            raise ValueError(f"snapshot {number} isn't the last one: another stream writes to {folder}")
        apply(snapshot(batch.sparkSession, folder, number - 1), one).write.mode("overwrite").parquet(f"{folder}/v={number}")
        last[0] = number

    query = events.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as e:
        if "the run's deadline" not in str(e):
            raise
    return last[0]


def counts_by_window(events: DataFrame, at: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts of events, streaming or not; an extension for watching the queue."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_at", length).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("string").alias("start"), "kind", "n")
