"""Literal gazetteers, similarity features and softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.operators import literals


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_zscore(df: DataFrame, value: str, group: str, name: str) -> DataFrame:
    """df and name: how many standard deviations (of the population) value is from its group's mean; 0 where it does not vary.
    Groups are summed up and joined back, so a group with a third of all rows is no task of its own."""
    spread = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    return df.join(spread, group).withColumn(name, F.when(F.col("_sd") == 0, 0.0).otherwise((F.col(value) - F.col("_m")) / F.col("_sd"))).drop("_m", "_sd")


def with_softmax(df: DataFrame, value: str, group: str, name: str) -> DataFrame:
    """df and name: exp(value) as a share of its group's sum, the group's greatest value taken off first."""
    most = df.groupBy(group).agg(F.max(value).alias("_most"))
    rows = df.join(most, group).withColumn("_e", F.exp(F.col(value) - F.col("_most")))
    sums = rows.groupBy(group).agg(F.sum("_e").alias("_sum"))
    return rows.join(sums, group).withColumn(name, F.col("_e") / F.col("_sum")).drop("_e", "_most", "_sum")


def gazetteer_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id for every item (item_id, text) whose text stands in a document by itself."""
    known = items.select("item_id", F.col("text").alias("literal"))
    return literals.found(docs, known, first_only=True).join(known, "literal").select("doc_id", "item_id")
