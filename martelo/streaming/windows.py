"""Event-time windows over the event stream: the same expressions run on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, lateness: str | None) -> DataFrame:
    return df.withWatermark("ts", lateness) if lateness and df.isStreaming else df


def tumbling(events: DataFrame, width: str = "1 day", lateness: str | None = "1 hour") -> DataFrame:
    found = _late(events, lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day", lateness: str | None = "1 hour") -> DataFrame:
    found = _late(events, lateness).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", lateness: str | None = "1 hour") -> DataFrame:
    found = _late(events, lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("first"))
    return found.select("user_id", "first", "n")
