"""Edges of event streams by window; an addition, as batch graphs are all that the models need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and users by window and type: start, event_type, n, users. Works on batches and streams."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    grouped = source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "users")
