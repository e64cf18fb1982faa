"""Traffic events: as-of joins and windowed roll-ups, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, row_id: str) -> DataFrame:
    """row_id and, of the right rows of its key at or before it, the value of the last (the greatest of equals).

    Both sides are merged and swept once in order of time: no join of all pairs, one shuffle.
    """
    none = F.lit(None)
    rows = right.select(key, at, F.lit(0).alias("_side"), F.col(value), none.cast("long").alias(row_id)).unionByName(left.select(key, at, F.lit(1).alias("_side"), none.cast("long").alias(value), row_id))
    sweep = Window.partitionBy(key).orderBy(at, "_side", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(sweep)).where("_side = 1").select(row_id, value)


def traffic(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and totals by window and event type; a stream needs a watermark on ts first."""
    w = F.window(F.col("ts").cast("timestamp"), width, slide) if slide else F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.unix_millis("w.start").alias("window_ms"), "event_type", "n", "total")
