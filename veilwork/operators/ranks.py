"""Ranks and order statistics that no single task has to sort.

``numbered`` numbers a whole table by a range shuffle. ``order_statistics`` finds exact values by rank, for each key, by histograms:
values are counted in BARS equal bars between the least and the greatest, the bar that holds the rank is cut again, and so on until
its values are one. A pass sends at most BARS counts a key and task, so a key of any size is worked on by all tasks.

Cases: null and NaN values take no part; ties have the same value whatever their order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.session import settled

BARS, BROADCAST_ROWS = 1024, 100_000


def with_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join to a settled table: a broadcast up to BROADCAST_ROWS, else a shuffle, of which Spark splits hot keys."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, how)


def numbered(rows: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """rows and their place in the order, from 0. The order should be total: of equals, any may come first."""
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a partition
    shifts = settled(parts.select("_part", (before - F.col("_first")).alias("_shift")))
    return with_small(placed, shifts, "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def order_statistics(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """key, n, and for each name in places the value at that place of the key's sorted values: a column of n, from 0 to n - 1."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("k"), F.col(value).alias("v"))
    span = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    targets = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items()]))
    state = settled(span.select("k", "n", "low", "high", targets.alias("t")).select("k", "n", "t.name", "t.at", "low", "high"))
    while not state.where("low < high").isEmpty():
        open_ = state.where("low < high")
        near = with_small(rows, open_, "k").where(F.col("v").between(F.col("low"), F.col("high")))
        bar = F.least(F.lit(BARS - 1), F.floor((F.col("v").cast("double") - F.col("low").cast("double")) / (F.col("high").cast("double") - F.col("low").cast("double")) * BARS))
        bars = near.groupBy("k", "n", "name", "at", bar.alias("bar")).agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("k", "name").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = bars.withColumn("before", before).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("rows")))
        state = settled(state.where("low >= high").unionByName(cut.select("k", "n", "name", (F.col("at") - F.col("before")).alias("at"), "low", "high")))
    return state.groupBy(F.col("k").alias(key)).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in places])


def nearest_rank(fraction: float) -> Column:
    """The place of a percentile by nearest rank."""
    return F.least(F.col("n") - 1, F.floor(F.lit(fraction) * F.col("n")))
