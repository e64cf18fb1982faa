"""Document fingerprints: SimHash with Spark expressions only.

The terms of a text are its shingles of five lower-cased words (a shorter text is one term), each as often as it occurs,
which is its weight. A term's 64-bit hash votes +1 or -1 on each bit; the fingerprint has the bits with a positive sum.
Votes are counted two bits to a long, 32 bits apart, which holds up to 2^32 terms.

``near`` finds all fingerprints within a Hamming radius r: the 64 bits are cut into 2 r blocks; two fingerprints that
differ in r bits agree on r blocks at least, so each choice of r blocks, moved to the front, is a table whose keys are
about 32 bits long, and all pairs within the radius meet in one of them. Fingerprints are made distinct first, so a
group of copies counts once.

Cases: null and empty texts have the fingerprint of no terms, all zeros; equal texts have equal fingerprints; repeated
rows stay; null ids sort as smallest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm import common

SHINGLE = 5
RADIUS = 3
ROWS_A_BLOCK, MOST_BLOCKS, HEAVY = 1024, 65_536, 4
PAIR = 0x0000000100000001


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the fingerprint of its column text, as a long; text must not be null."""
    ws, hs, votes = f"_w_{name}", f"_h_{name}", f"_v_{name}"
    df = df.withColumn(ws, common.words(F.lower(F.col(text))))
    shingle = f"transform(slice({ws}, 1, greatest(size({ws}) - {SHINGLE - 1}, 1)), (w, i) -> xxhash64({', '.join(['w', *[f'get({ws}, i + {k})' for k in range(1, SHINGLE)]])}))"
    df = df.withColumn(hs, F.expr(shingle))
    zero = ", ".join(f"'c{i}', 0L" for i in range(32))
    add = ", ".join(f"'c{i}', v.c{i} + (shiftrightunsigned(h, {i}) & {PAIR}L)" for i in range(32))
    df = df.withColumn(votes, F.expr(f"aggregate({hs}, named_struct({zero}), (v, h) -> named_struct({add}))"))
    half = f"size({hs})"
    bits = " | ".join(f"if(2 * ({votes}.c{i} & 4294967295L) > {half}, {1 << i}L, 0L) | if(2 * shiftrightunsigned({votes}.c{i}, 32) > {half}, shiftleft({1 << i}L, 32), 0L)" for i in range(32))
    return df.withColumn(name, F.expr(bits)).drop(ws, hs, votes)


def hexed(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def dealt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (doc_id, _tie) with _block, and a row a block: _block, head (its greatest id and tie).

    Blocks are of equal width between the least and the greatest id, about ROWS_A_BLOCK rows each and never more than MOST_BLOCKS,
    which bounds the table of heads. A block with more than HEAVY times its share, as beside an id far off, is cut by its own least
    and greatest id, and one of a single id by the ties, until none is left; only rows equal in both stay together.
    """
    least, most, count = df.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    blocks = max(1, min(MOST_BLOCKS, -(-count // ROWS_A_BLOCK)))
    share = max(1, -(-count // blocks))
    width = max((float(most) - float(least)) / blocks, 1.0) if least is not None else 1.0
    first = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(least or 0))) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    df = df.withColumn("_block", F.array(first))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "_tie")
    while True:
        heads = common.materialize(df.groupBy("_block").agg(F.max(order).alias("head"), F.min(order).alias("tail"), F.count("*").alias("_n")))
        heavy = heads.where((F.col("_n") > HEAVY * share) & (F.col("head") != F.col("tail")))
        if heavy.isEmpty():
            return df, heads.select("_block", "head")
        parts = F.ceil(F.col("_n") / F.lit(share)).cast("double")
        by_id = F.col("head.id") > F.col("tail.id")
        low, high = (F.when(by_id, F.col(f"{x}.id").cast("double")).otherwise(F.col(f"{x}._tie").cast("double")) for x in ("tail", "head"))
        cuts = heavy.select("_block", by_id.alias("_by_id"), low.alias("_low"), (F.greatest(high - low, F.lit(1.0)) / parts).alias("_wide"))
        at = F.when(F.col("_by_id"), F.col("doc_id").cast("double")).otherwise(F.col("_tie").cast("double"))
        part = F.coalesce(F.floor((at - F.col("_low")) / F.col("_wide")).cast("long"), F.lit(0).cast("long"))
        df = df.join(F.broadcast(cuts), "_block", "left").withColumn("_block", F.concat("_block", F.array(part))).drop("_by_id", "_low", "_wide")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (with a long doc_id) and next_<c> for each of columns, from the next row by descending doc_id, null ids last;
    the row after the last is the first. Of equal ids, the greater hash of the first column comes first.

    Each block's first row is sent, as a copy, also to the block above it, where it follows the last row.
    """
    df, heads = dealt(df.withColumn("_tie", F.xxhash64(columns[0])))
    above = F.coalesce(F.lag("_block").over(Window.orderBy(F.desc("_block"))), F.min("_block").over(Window.partitionBy()))
    heads = heads.select(above.alias("_to"), "head.id", "head._tie")
    rows = df.join(F.broadcast(heads), (F.coalesce(df["doc_id"], F.lit(-(1 << 63))) == heads["id"]) & (df["_tie"] == heads["_tie"]), "left").drop(heads["id"]).drop(heads["_tie"])
    here, there = F.struct(F.col("_block").alias("block"), F.lit(0).alias("copy")), F.struct(F.col("_to").alias("block"), F.lit(1).alias("copy"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    w = Window.partitionBy("_at.block").orderBy("_at.copy", F.desc_nulls_last("doc_id"), F.desc("_tie"))
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.where("_at.copy = 0").drop("_at", "_to", "_block", "_tie")


def near(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) for all pairs a < b of different fingerprints (column fingerprint, long) within the radius."""
    r = max(1, radius)
    cuts = [round(64 * i / (2 * r)) for i in range(2 * r + 1)]
    full = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen) & full for chosen in combinations(range(2 * r), r)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])
    table = fingerprints.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.explode(keys).alias("key"))
    other = table.select(F.col("fingerprint").alias("b"), "key")
    pairs = table.withColumnRenamed("fingerprint", "a").join(other, "key").where("a < b")
    return pairs.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance")).where(F.col("distance") <= radius).distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (16 hexadecimal digits) of every row."""
    df = docs.select("doc_id", common.text_of().alias("text"))
    return with_fingerprint(df, "text", "fp").select("doc_id", hexed("fp").alias("fingerprint"))
