"""Benchmark decontamination: a distributed positional inverted index, with Spark expressions only.

``index`` stores a posting (term, row, pos) for every training word that is a word of the test items, in segments: each task's
output is sorted by term, row and position, so nothing is shuffled to build it, and a term's postings lie together. A term's code is
the hash of the word; a row's number is its place in the scan. Each row also has one posting of the empty term, at the position after
its last word: it tells the row's id and its number of words.

``matches`` looks windows up, runs of ``size`` item words:

1. Terms are counted over the whole index. A window with a term that the training rows lack cannot occur.
2. The LISTS rarest terms of each window are read: a posting of a term that is at place q of an item suggests that the item stands in the row at
   pos - q. These offset-adjusted lists are intersected: only an alignment (row, item, offset) that as many of them have goes on.
3. The lists of all other terms complete the alignments that are left; each run of ``size`` neighbouring places is an exact match.

``near`` gives proximity matches: rows that have a window's rarest terms within a span of words, in any order.

Cases: null and empty texts have no words and are never hit; an item without words has no window, one with fewer than ``size`` words
is a window as a whole; long texts are indexed whole; repeated rows are rows each, with equal results; equal items are items each,
those of equal ids count once in a row's items, a null id as an empty one; ties between terms of equal rarity are broken by their place; an
empty table of either kind gives rows without hits, or none; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm import common

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZE, LISTS = 10, 3


def lowered(word: Column) -> Column:
    """A-Z lower-cased, and nothing else; lower() is the faster way for words of ASCII letters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def terms(text: str = "text") -> Column:
    return F.regexp_extract_all(common.text_of(text), F.lit(RAW_TERM), F.lit(0))


def test_terms(items: DataFrame) -> DataFrame:
    """A written table of the items' words: item (a number), item_id, n (words of the item), q (place), term."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), terms().alias("words"))
    rows = numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "word")).withColumn("word", lowered(F.col("word")))
    rows = common.materialize(rows.withColumn("term", F.xxhash64("word")))
    words, codes = rows.agg(F.count_distinct("word"), F.count_distinct("term")).first()
    if words != codes:
        raise ValueError("two words of the items have one code")
    return rows


def index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A written table: term (null for the posting that tells a row's words), row, pos, doc_id (of that posting only)."""
    vocabulary = common.materialize(items.select("word", "term").distinct().unionByName(items.sparkSession.sql("select '' word, bigint(null) term")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(terms(), F.array(F.lit(""))).alias("words"))
    rows = rows.select("doc_id", "row", F.posexplode("words").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    postings = common.written_join(rows, vocabulary, "word").select("term", "row", "pos", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id"))
    return common.materialize(postings.sortWithinPartitions("term", "row", "pos"))


def rarest(items: DataFrame, postings: DataFrame, size: int, lists: int) -> DataFrame:
    """item, start, q, term, rank, length: the rarest terms of each window, from 1; windows with a term that has no posting are left out."""
    counts = postings.where("term is not null").groupBy("term").count()
    known = common.written_join(items, common.materialize(counts), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - (size - 1)), F.greatest(F.lit(0), F.least("q", F.col("n") - size)))
    places = known.select("item", "q", "term", "count", F.least("n", F.lit(size)).alias("length"), F.explode(starts).alias("start"))
    window = Window.partitionBy("item", "start")
    places = places.withColumns({"rank": F.row_number().over(window.orderBy("count", "q")), "least": F.min("count").over(window)})
    return places.where((F.col("rank") <= lists) & (F.col("least") > 0)).drop("least")


def matches(items: DataFrame, postings: DataFrame, size: int = SIZE, lists: int = LISTS) -> DataFrame:
    """row, item_id, start, end: words start to end of the row are a run of windows of the item."""
    first = rarest(items, postings, size, lists)
    places = common.materialize(first.select("item", "q", "term", F.least("length", F.lit(lists)).alias("least")).distinct())
    lists_ = lookup(postings.where("term is not null").select("term", "row", "pos"), places, "term")
    aligned = lists_.select("row", "item", (F.col("pos") - F.col("q")).alias("offset"), "least")
    left = common.materialize(aligned.groupBy("row", "item", "offset").agg(F.count("*").alias("found"), F.min("least").alias("least")).where("found >= least").select("row", "item", "offset"))
    wanted = lookup(left, items.select("item", "item_id", "n", "q", "term"), "item").select("row", "item", "item_id", "offset", "n", "q", "term", (F.col("offset") + F.col("q")).alias("pos"))
    rows = left.select("row").distinct()
    there = lookup(postings.where("term is not null").select("term", "row", "pos"), common.materialize(rows), "row")
    complete = wanted.join(there, ["row", "pos", "term"])
    run = Window.partitionBy("row", "item", "offset").orderBy("q")
    islands = complete.withColumn("island", F.col("q") - F.row_number().over(run)).groupBy("row", "item", "item_id", "offset", "n", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    return islands.where(F.col("end") - F.col("start") + 1 >= F.least("n", F.lit(size))).select("row", "item_id", "start", "end")


def lookup(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join postings to a written table, whose keys may repeat: a broadcast up to BROADCAST_ROWS, else a shuffle that Spark can split."""
    return big.join(F.broadcast(small) if small.count() <= common.BROADCAST_ROWS else small, key)


def near(items: DataFrame, postings: DataFrame, span: int, size: int = SIZE, lists: int = LISTS) -> DataFrame:
    """row, item, start (of the window): rows that have the window's lists rarest places' terms within span words, in any order.

    A posting is put into two stretches of 2 * span words that overlap by half, so each span lies in one of them as a whole.
    """
    first = rarest(items, postings, size, lists).select("item", "start", "term").distinct()
    needed = first.groupBy("item", "start").agg(F.count("*").alias("needed"))
    places = common.materialize(first.join(needed, ["item", "start"]))
    found = lookup(postings.where("term is not null").select("term", "row", "pos"), places, "term")
    at = F.floor(F.col("pos") / span)
    found = found.select("row", "item", "start", "needed", "term", "pos", F.explode(F.array(at, at - 1)).alias("stretch"))
    stretches = found.groupBy("row", "item", "start", "needed", "stretch").agg(F.count_distinct("term").alias("kinds"), F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("list")).where("kinds = needed")
    within = F.exists("list", lambda x: F.size(F.array_distinct(F.transform(F.filter("list", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + span)), lambda y: y["term"]))) == F.col("needed"))
    return stretches.where(within).select("row", "item", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items with occurring windows) of every row of docs."""
    items = test_terms(benchmark)
    postings = index(docs, items)
    found = common.materialize(matches(items, postings, size))
    before = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, before))
    hits = found.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = postings.where("term is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(hits, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
