"""Structured Streaming forms of the incremental operators; the batch forms define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claimed_once(items: DataFrame, at: str, key: str, late: str = "7 days") -> DataFrame:
    """STR-01, STR-02: items older than the watermark are never seen, and the first to claim a key within it stays."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(items: DataFrame, at: str, width: str, *by: str, late: str = "1 day") -> DataFrame:
    """STR-07: counts in tumbling windows; on a batch the watermark is ignored."""
    return items.withWatermark(at, late).groupBy(F.window(at, width), *by).count().select(F.col("window.start").alias("start"), *by, F.col("count").alias("n"))
