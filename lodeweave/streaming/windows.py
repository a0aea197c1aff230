"""Event-time windows over usage and actions: an extension on Spark's engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count and sum of value by key and tumbling or sliding window; rows later than ``late`` are dropped in streams."""
    w = F.window("at", length, slide) if slide else F.window("at", length)
    rows = events.withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    rows = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Drop repeats of keys within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
