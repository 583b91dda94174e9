"""Structured Streaming forms of the ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, content: str, time: str, within: str) -> DataFrame:
    """Rows whose content did not come before, within a watermark; the state is one hash a content."""
    return rows.withWatermark(time, within).withColumn("_k", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def running_counts(rows: DataFrame, key: str, time: str, window: str, within: str) -> DataFrame:
    """Counts and sums of ``value`` by key and event-time window."""
    return rows.withWatermark(time, within).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
