"""Extension, not part of the reference's scope: demand refreshed from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_demand(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream (ts, user_id, event_type, value) -> sums of value by window and type; rows later than ``late`` are left out."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.sum("value").alias("weight"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "weight", "n")
