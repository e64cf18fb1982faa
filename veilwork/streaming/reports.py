"""Reports that come late or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def once(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first of the events with equal keys within the delay; later ones patch nothing here."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def with_late(exchanges: DataFrame, reports: DataFrame, key: str, delay: str) -> DataFrame:
    """exchanges with the verdict that comes after them, up to the delay (both have ``at``); none is an outer row of nulls once the
    watermark has passed, and a verdict of an unknown exchange is dropped."""
    a = exchanges.withWatermark("at", delay)
    b = reports.select(F.col(key).alias("_key"), F.col("at").alias("_at"), *[c for c in reports.columns if c not in (key, "at")]).withWatermark("_at", delay)
    return a.join(b, (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col("at")) & (F.col("_at") <= F.col("at") + F.expr(f"interval {delay}")), "left").drop("_key", "_at")
