"""Interval join: pairs of spans of two tables that overlap, without all pairs of a document.

Spans lie in stretches of equal width; a pair is found in each stretch that both touch, and kept in the first of these only, which is where
the later of the two begins. So no pair is made twice, and a document of many spans is spread over its stretches.

Cases: spans are half-open; a null end or start overlaps nothing; an empty span overlaps what it lies inside of; repeated spans are
spans each; a span that is much longer than the width is in many stretches, so the width follows the mean length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def width_for(*spans: DataFrame) -> int:
    """Twice the mean length of the longer kind of spans, at least 1."""
    means = [s.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0 for s in spans]
    return max(1, int(2 * max(means)))


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """Pairs of rows of a and b (key, start, end, ...) with a.start < b.end and b.start < a.end; b's columns have the prefix b_."""
    width = width or width_for(a, b)
    b = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    stretch = lambda at: F.floor(at / width).cast("long")

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(end) - 1)
        return df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_stretch", F.explode(F.sequence(stretch(F.col(start)), stretch(last))))

    pairs = dealt(a, "start", "end").join(dealt(b, "b_start", "b_end"), [key, "_stretch"])
    home: Column = stretch(F.greatest("start", "b_start")) == F.col("_stretch")
    return pairs.where(home & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))).drop("_stretch")
