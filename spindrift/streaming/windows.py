"""Structured Streaming additions: event-time windows, sessions, dedup, and a bounded pull."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    """Counts by window of ``width``; works on batch and streaming input alike."""
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(ts, width, step).alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def dedup(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """At-least-once input made exactly-once by key within the watermark (T5)."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def pull_files(spark: SparkSession, path: str, schema, fold: Callable[[DataFrame, int], None], checkpoint: str, files_per_wave: int = 16) -> int:
    """All files of a folder in bounded waves, each given to ``fold``; a rerun goes on where it stopped.

    Returns the number of waves of this run.
    """
    waves = []

    def step(batch: DataFrame, number: int) -> None:
        waves.append(number)
        fold(batch, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_wave).parquet(path)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(waves)
