"""Structured Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by type in tumbling windows; later events than the watermark allows are left out. Works on a stream and on a table."""
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def latest_by_user(events: DataFrame) -> DataFrame:
    """The last event of each user, by time and id: in update mode on a stream."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("e")
    return events.groupBy("user_id").agg(last, F.count("*").alias("n")).select("user_id", "n", "e.ts", "e.event_id", "e.event_type", "e.value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user without a longer pause than gap."""
    g = events.withWatermark("ts", late) if events.isStreaming else events
    return g.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def each_batch(stream: DataFrame, work, checkpoint: str):
    """Run work on every micro-batch; a batch that fails is retried from the checkpoint."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).outputMode("append").start()
