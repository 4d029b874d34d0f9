"""Structured Streaming over the event table (an engine extra: the inventory's source has no streams).

Tumbling windows with a watermark, de-duplication within it, and sessions; each runs the same logic as its batch query, so a drained stream equals the batch.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).start.alias("start") if not events.isStreaming else F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Run a stream over all available input into a Parquet folder."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", tempfile.mkdtemp(prefix="orrery-stream-")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
