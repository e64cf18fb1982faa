"""Text corpora, captures and runs on a file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bounds of the capture store
MOST_BODIES, MOST_BYTES = 2000, 128 << 20


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (below root) and text of every file of the pattern, at any depth."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    below = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return files.select(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("text"))


def identified(files: DataFrame) -> DataFrame:
    """files (path, text) with id (the DOC number in the name, else the name made safe) and category (the first folder)."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    number = F.regexp_extract(name, r"(?i)(DOC-[0-9]+)", 1)
    category = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    return files.withColumns({"id": F.when(number != "", F.upper(number)).otherwise(F.regexp_replace(name, r"[^\w.-]+", "-")), "category": category})


def load(files: DataFrame) -> DataFrame:
    """doc_id, category, path, title, bytes, lines, text. Of files with one id, by path, all but the first get -2, -3 and so on; the
    title is the first heading, else the id."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    rows = identified(files).withColumn("doc_id", F.when(n > 1, F.concat("id", F.lit("-"), n.cast("string"))).otherwise(F.col("id")))
    title = F.trim(F.regexp_extract("text", r"(?m)^#[ \t]+(.+)$", 1))
    return rows.select("doc_id", "category", "path", F.when(title != "", title).otherwise(F.col("doc_id")).alias("title"), F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n", -1)).alias("lines"), "text")


def latest(captures: DataFrame, most: int = MOST_BODIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """captures (run, doc, at, bytes): the last of each run and document, of these the newest within both bounds, one at least.

    The newest ``most`` are a top-k (tasks send no more than that many rows each); the running sum is over these alone.
    """
    last = captures.groupBy("run", "doc").agg(F.max_by(F.struct(*[c for c in captures.columns if c not in ("run", "doc")]), F.struct("at", "bytes")).alias("x")).select("run", "doc", "x.*")
    newest = last.orderBy(F.desc("at"), "run", "doc").limit(most)
    upto = F.sum("bytes").over(Window.orderBy(F.desc("at"), "run", "doc"))
    first = F.row_number().over(Window.orderBy(F.desc("at"), "run", "doc")) == 1
    return newest.withColumns({"_upto": upto, "_first": first}).where((F.col("_upto") <= most_bytes) | F.col("_first")).select(captures.columns)


def write_run(rows: DataFrame, root: str, table: str) -> None:
    """Append a run's rows (with run_id) to the table: a folder a run, written once."""
    rows.write.partitionBy("run_id").mode("append").parquet(f"{root}/{table}")


def listed(runs: DataFrame, summaries: DataFrame, most: int = 200) -> DataFrame:
    """run_id, complete and the summary's columns, newest first; a run without summary is listed as not complete."""
    valid = runs.select("run_id").where(F.col("run_id").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]+Z$")).distinct()
    return valid.join(summaries.withColumn("complete", F.lit(True)), "run_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False))).orderBy(F.desc("run_id")).limit(most)


def run_id(at: Column) -> Column:
    return F.replace(F.replace(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")), F.lit(":"), F.lit("-")), F.lit("."), F.lit("-"))


def report(headline: DataFrame, kinds: DataFrame) -> str:
    """A run's report in Markdown, from its one row of ratios and its row a kind."""
    share = lambda x: "–" if x is None else f"{100 * x:.1f} %"
    (row,) = headline.collect()
    lines = ["# Evaluation run", "", "| Measure | Value |", "|---|---|", *[f"| {c.replace('_', ' ')} | {share(row[c])} |" for c in headline.columns], "", "| Kind | Total | Replaced | Partial | Leaked | Damaged |", "|---|---|---|---|---|---|"]
    lines += [f"| {r['kind']} | {r['total']} | {r['replaced']} | {r['partial']} | {r['leaked']} | {r['damaged']} |" for r in kinds.orderBy(F.desc("total"), "kind").collect()]
    return "\n".join(lines) + "\n"
