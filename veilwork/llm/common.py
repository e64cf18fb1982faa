"""Small helpers that the training-data operators share.

``words`` and ``n_words`` are the word definition of all operators: runs of characters other than
U+0020 and U+0009..U+000D; null text counts as empty.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; larger tables are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALT = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, if driver and executors are
    one process, else an error: other machines would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="veilwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/veilwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing needs any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("veilwork-"):
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Send texts to Python in batches of at most so many bytes (a row more, where one is larger): a worker's memory does
    not depend on how long texts are. Plans read the setting when they run, so it stays set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, f"{size}b")


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a large table to one that is usually small.

    small is a written table, so counting it is cheap. Up to BROADCAST_ROWS it is broadcast; beyond, both sides are
    salted so that a key holding a third of big's rows is spread over SALT tasks. Spark takes the salted table for as small
    as its file, and would broadcast all SALT copies of it: the hint keeps it from that.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c != key][:1]), F.lit(SALT)).cast("int"))
    return dealt.join(salted.hint("merge"), [key, "_salt"], how).drop("_salt")


def written_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join a large table to a written one with unique keys: a broadcast up to BROADCAST_ROWS, else a shuffle. No aggregate shares
    the join's stage, so Spark splits the tasks of a key that holds a third of big's rows (adaptive skew join)."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, key, how)


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) links -> (id long, component long): the smallest id reachable from each id that has a link.

    Alternating large-star and small-star rounds until nothing changes; each keeps connectivity, and the number of links never
    grows. All state stays in written tables; the driver sees only a count per round. Empty input gives an empty result.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        near = both(now)
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of u, and u itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        then = materialize(small)
        old = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        new = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = then
        if old == new:
            break
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = stars.select(F.col("component").alias("id"), "component").distinct()
    return stars.select(F.col("a").alias("id"), "component").unionByName(roots).distinct()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))
