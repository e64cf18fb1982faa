"""URL filters: a sort-merge range join of urls with rules.

A rule (host, path) fits its host and all subdomains, if the url's path starts with the rule's. A host's canonical key is
its labels in reverse, each ended by U+0001, so a rule's host is a prefix of the keys it fits: an interval. Urls and
rules are dealt into ranges of keys and sorted; one sweep over each range keeps a stack of the active, nested rule hosts
and gives each url the longest rule on it (by the length of host and path; of equals, the longer host).

Range bounds come from a sample of keys (SAMPLE a range of at most RANGE rows); they decide the balance, never the result: a rule goes
to each range that its interval touches, which for nested rules is its own ranges and the few that it spans. Keys go on
with the path and a hash of the id, so a host, or a single url, with a third of all rows is spread over many ranges.

Cases: null urls, and urls without ://, have an empty host and path, which no rule fits; urls that no rule fits get the
default verdict; a rule with a null host or path fits nothing; repeated rows and ids stay; of equal rules the first by verdict counts; an empty table of either side
works; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE, RANGE = 16, 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str | Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key(name: str | Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.", -1)), "\x01"), F.lit("\x01"))


def bounds_of(places: DataFrame) -> list[str]:
    """Bounds of ranges of a table's one string column, distinct and sorted: as many as give RANGE rows a range, and twice the
    shuffle partitions at least. They come from SAMPLE keys a range, the same on each run, whatever the number of tasks."""
    (column,) = places.columns
    count = places.count()
    n = max(2 * int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE))
    share = min(1.0, n * SAMPLE / max(1, count))
    seen = sorted(r[0] for r in places.where(F.pmod(F.xxhash64(column, F.lit(7)), F.lit(1 << 31)) < share * (1 << 31)).collect())
    return sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages: page_id, url; rules: host, path, verdict. Gives page_id, host, path, rule (host and path, or null), verdict."""
    kind = dict(pages.dtypes)["page_id"]
    # ids travel as text: pandas would make numbers with nulls inexact
    urls = pages.select(F.col("page_id").cast("string").alias("page_id"), host("url").alias("host"), path("url").alias("path"))
    urls = urls.select("*", key("host").alias("key"), F.concat_ws("\x00", key("host"), "path", F.hex(F.xxhash64("page_id"))).alias("place"))
    bounds = bounds_of(urls.select("place"))

    # Python compares str by code point, as Spark compares UTF-8 bytes
    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return place.map(lambda p: bisect_right(bounds, p)).astype("int32")

    rule_key = key(F.translate("host", UPPER, LOWER))
    ruled = rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict", rule_key.alias("key"))
    first, last = range_of("key"), range_of(F.concat("key", F.lit("\U0010ffff")))
    ruled = ruled.select("*", F.explode(F.sequence(first, last)).alias("range"))
    none = F.lit(None).cast("string")
    rows = urls.select(range_of("place").alias("range"), "place", F.lit(1).alias("kind"), "page_id", "host", "path", "key", none.alias("verdict")).unionByName(
        ruled.select("range", F.col("key").alias("place"), F.lit(0).alias("kind"), none.alias("page_id"), "host", "path", "key", "verdict")
    )

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []  # of (key, {path: (host, path, verdict)}, lengths of paths, longest first)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.range != at:
                    at, stack = r.range, []
                while stack and not r.key.startswith(stack[-1][0]):
                    stack.pop()
                if r.kind == 0:
                    if not stack or stack[-1][0] != r.key:
                        stack.append((r.key, {}, []))
                    _, paths, sizes = stack[-1]
                    if r.path not in paths or r.verdict < paths[r.path][2]:
                        paths[r.path] = (r.host, r.path, r.verdict)
                        if len(r.path) not in sizes:
                            sizes.append(len(r.path))
                            sizes.sort(reverse=True)
                    continue
                best, most = None, (-1, -1)
                for _, paths, sizes in stack:
                    for n in sizes:
                        if n <= len(r.path) and (found := paths.get(r.path[:n])):
                            if (size := (len(found[0]) + n, len(found[0]))) > most:
                                best, most = found, size
                            break
                out.append((r.page_id, r.host, r.path, best and best[0] + best[1], best[2] if best else default))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])

    schema = "page_id string, host string, path string, rule string, verdict string"
    out = rows.repartition("range").sortWithinPartitions("range", "place", "kind").drop("place").mapInPandas(sweep, schema)
    return out.withColumn("page_id", F.col("page_id").cast(kind))
