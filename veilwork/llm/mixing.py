"""Mixing sources to target weights: hash-threshold histograms.

Every document has a hash of its id and text. A source's budget of words becomes a threshold on that hash: the source's
words are summed by the leading byte of the hash, the bucket in which the running sum passes the budget is found, and
only that bucket is summed again by the next byte, until it holds one document. Documents below the threshold are taken;
nothing is sorted, and each pass shuffles at most 256 sums a source and task. A source that must give more than it has
gives every document once and takes the threshold for the second copy.

Cases: null text has size 0; null source is a source of its own, ranked last; rows equal in id and text share a hash and
are taken together; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veilwork.llm import common

WEIGHTS, RATIO, MOST = (5, 2, 1), 1.5, 2
BYTES = 16  # of the hash, as 32 hexadecimal digits


def measures() -> list:
    """key (source, or its stand-in where null), size in words, hash as hexadecimal text."""
    text = common.text_of()
    return [
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")).alias("key"),
        F.size(common.words(text)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("hash"),
    ]


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table that all sums are taken from: doc_id, source, key, size, hash."""
    return docs.select("doc_id", "source", *measures())


def targets(sizes: DataFrame, weights=WEIGHTS, ratio=RATIO, most=MOST) -> DataFrame:
    """A row for each source: key, source_size, target. The windows run over sources, a dimension, not over documents.

    Targets are min(most * size, level * weight); the level is the largest of the levels that result when the sources
    with the smallest caps a weight are taken as full, one after the other.
    """
    by = sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / open_weight).withColumn("level", F.max("level").over(everything))
    return by.select("key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, source_size, target, copies (0 or 1 of every document), prefix, whole: the hashes whose leading digits are
    below prefix are taken once more, and those with these digits if whole."""
    state = common.materialize(
        wanted.withColumn("copies", (F.col("target") >= F.col("source_size")).cast("int"))
        .withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("*", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"), F.lit(0).cast("long").alias("rows"))
    )
    for level in range(1, BYTES + 1):
        known = state.select("key", "budget", "prefix", "below")
        inside = common.lookup_join(sizes.select("key", "hash", "size"), known, "key").where(F.col("hash").startswith(F.col("prefix")))
        bars = inside.groupBy("key", F.substring("hash", 1, 2 * level).alias("bar"), "budget", "below").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        so_far = Window.partitionBy("key").orderBy("bar")
        bars = bars.withColumns({"upto": F.col("below") + F.sum("words").over(so_far), "last": F.lead("bar").over(so_far).isNull()})
        # the first bar that passes the budget, else the last bar
        edge = bars.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")) | F.col("last") & (F.col("upto") <= F.col("budget")))
        edge = edge.select("key", F.col("bar").alias("prefix"), (F.col("upto") - F.col("words")).alias("below"), F.col("words").alias("inside"), "rows")
        state = common.materialize(state.drop("prefix", "below", "inside", "rows").join(edge, "key"))
        if (state.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    return state.select("key", "source_size", "target", "copies", "prefix", (2 * (F.col("budget") - F.col("below")) >= F.col("inside")).alias("whole"))


def taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (with key, size, hash) and source_size, target, copies: how often the mix takes the document (0, 1 or 2)."""
    digits = F.expr("left(hash, length(prefix))")
    more = (digits < F.col("prefix")) | (digits == F.col("prefix")) & F.col("whole")
    return common.lookup_join(rows, cuts, "key").withColumn("copies", F.col("copies") + more.cast("int")).drop("prefix", "whole", "hash", "key")


def plan(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, most=MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every document, from the narrow table alone."""
    sizes = common.materialize(sized(docs))
    return taken(sizes, thresholds(sizes, targets(sizes, weights, ratio, most)))


def mix(docs: DataFrame, weights=WEIGHTS, ratio=RATIO, most=MOST) -> DataFrame:
    """The mix itself: the rows of docs, those taken twice repeated, those not taken left out; same columns."""
    sizes = common.materialize(sized(docs))
    cuts = thresholds(sizes, targets(sizes, weights, ratio, most))
    rows = taken(docs.select(F.struct("*").alias("doc"), *measures()), cuts)
    return rows.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")
