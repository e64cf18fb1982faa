"""Quality rules: a learned decision list, as Spark conditional expressions.

Sequential covering on labelled rows: a rule starts empty and grows by the threshold condition with the largest FOIL
gain on two thirds of the rows, is pruned back to the prefix that does best on the last third, and is kept if it is
precise there; the rows it covers go, and the next rule is grown. All numbers come from histograms that Spark counts
over binned features (features x BINS x 2 counts reach the driver); rules reject, in order, and what none covers stays.

Cases: null text counts as empty; empty texts have all features 0; an id that several rows share has a label for each of
them; null labels are left out; without labelled rows, or of one label only, the list is empty and keeps everything;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm import common

SYMBOLS = "#*$%&|<>"
#: Lines with a word, distinct words, digits, capitals, and how many of the stop words the text has
MORE = ("n_lines", "n_distinct", "n_digits", "n_capitals", "n_stop")
STOP = ("the", "of", "and", "to", "der", "die", "und", "in", "de", "la", "le", "et", "les", "el", "que", "los")
BINS = 64
#: Labelled rows learned from, at most, chosen by a hash of the id: bounds the cost of learning, not what is judged.
MOST_LABELLED = 500_000
MOST_RULES, MOST_CONDITIONS, LEAST_COVERED, LEAST_PRECISION = 8, 4, 5, 0.8


def with_base(df: DataFrame, text: str = "text", more: bool = False) -> DataFrame:
    """df and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of its column text; with more, also MORE."""
    df = df.withColumn("_t", common.text_of(text))
    df = df.withColumn("_w", common.words(F.col("_t")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("_g", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))"))
    # starts of windows that occur twice: neighbours in hash order; sorted only where some window repeats
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_g)) = size(_g), array(), array_sort(transform(_g, (h, i) -> named_struct('h', h, 'i', i))))"))
    df = df.withColumn("_d", F.expr("array_sort(transform(filter(_s, (s, i) -> s.h <=> get(_s, i - 1).h or s.h <=> get(_s, i + 1).h), s -> s.i))"))
    covered = F.expr("aggregate(zip_with(_d, slice(_d, 2, size(_d)), (a, b) -> least(3, coalesce(b, a + 3) - a)), 0L, (n, k) -> n + k)")
    df = df.withColumn("_u", F.array_distinct("_w"))
    also = {
        "n_lines": F.size("_l"), "n_distinct": F.size("_u"), "n_digits": F.length("_t") - F.length(F.translate("_t", "0123456789", "")),
        "n_capitals": F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")), "n_stop": F.size(F.array_intersect(F.transform(F.filter("_u", lambda w: F.length(w) <= 3), lambda w: F.lower(w)), F.array(*[F.lit(w) for w in STOP]))),
    }
    return df.select(
        *[c for c in df.columns if c[0] != "_" or c not in ("_t", "_w", "_l", "_g", "_s", "_d", "_u")],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        *[also[c].cast("long").alias(c) for c in MORE if more],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What conditions may test: counts and shares of the base numbers and of MORE; 0 where a text has no words."""
    share = lambda a, of="n_words": F.coalesce(F.try_divide(F.col(a), F.col(of)), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars"), "symbol_share": share("n_symbols"), "dup_lines": F.col("n_dup_lines").cast("double"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words"),
        "line_words": share("n_words", "n_lines"), "distinct_share": share("n_distinct"), "digit_share": share("n_digits", "word_chars"), "capital_share": share("n_capitals", "word_chars"), "stop_words": F.col("n_stop").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > at, else feature <= at
    at: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > F.lit(self.at) if self.above else x <= F.lit(self.at)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a rule is a conjunction of conditions. A document that a rule covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def verdict(self) -> Column:
        """Column over the base numbers: which rule (from 1) rejects the document, 0 if none does."""
        out = None
        for n, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, n) if out is None else out.when(test, n)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.at:g}" for c in r) for r in self.rules)


def learn(measured: DataFrame, labels: DataFrame) -> DecisionList:
    """measured: doc_id, the base numbers and MORE; labels: doc_id, quality (1 good, 0 bad), as from ``sampled``."""
    names = list(features())
    labels = labels.where("quality is not null").select(F.col("doc_id").alias("_id"), "quality")
    rows = measured.join(labels, F.col("doc_id") == F.col("_id"))
    order = F.xxhash64("doc_id")
    rows = common.materialize(rows.select((F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(order, F.lit(3)) == 2).alias("held"), *[c.alias(n) for n, c in features().items()]))
    points = rows.agg(*[F.percentile_approx(n, [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in names]).first()
    edges = {n: sorted({*(points[n] or ())}) for n in names}
    # of values below the edge nothing is lost, and zero is the natural edge of counts
    edges = {n: sorted({0.0, *e}) for n, e in edges.items()}
    bins = [F.expr(f"size(filter(array({', '.join(f'double({e!r})' for e in edges[n])}), e -> e < {n}))").alias(f"b_{n}") for n in names]
    rows = common.materialize(rows.select("bad", "held", *bins))

    def tally(rule: list[tuple[str, bool, int]], left: DataFrame) -> dict:
        for n, above, b in rule:
            left = left.where(F.col(f"b_{n}") > b if above else F.col(f"b_{n}") <= b)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"b_{n}").alias("b")) for n in names])).alias("x")
        out = left.select("bad", "held", each).groupBy("x.n", "x.b", "held").agg(F.sum("bad").alias("bad"), F.count("*").alias("all")).collect()
        return {(r["n"], r["b"], r["held"]): (r["bad"], r["all"] - r["bad"]) for r in out}

    def sums(t: dict, n: str, held: bool, above: bool, b: int) -> tuple[int, int]:
        found = [v for (m, c, h), v in t.items() if m == n and h == held and (c > b) == above]
        return sum(v[0] for v in found), sum(v[1] for v in found)

    rules, left = [], rows
    while len(rules) < MOST_RULES:
        rule, tried = [], []
        t = tally(rule, left)
        p0, n0 = sums(t, names[0], False, True, -1)
        while p0 and n0 and len(rule) < MOST_CONDITIONS:
            best = max(((p * (log2(p / (p + q)) - log2(p0 / (p0 + n0))), n, above, b, p, q) for n in names for b in range(len(edges[n])) for above in (True, False) for p, q in [sums(t, n, False, above, b)] if p >= LEAST_COVERED), default=None)
            if best is None or best[0] <= 1e-9:
                break
            _, n, above, b, p0, n0 = best
            rule.append((n, above, b))
            tried.append((sums(t, n, True, above, b), (p0, n0)))
            t = tally(rule, left)
        # prune: the prefix that does best on the rows held back; of equals, the shortest
        worth = [((p - q) / (p + q) if p + q else -1.0, -i) for i, ((p, q), _) in enumerate(tried)]
        if not worth:
            break
        i = -max(worth)[1]
        (p, q), (gp, gq) = tried[i]
        if p + gp < LEAST_COVERED or (p + gp) / max(1, p + gp + q + gq) < LEAST_PRECISION or worth[i][0] <= 0:
            break
        rules.append(rule[: i + 1])
        miss = common.any_of([F.col(f"b_{n}") <= b if above else F.col(f"b_{n}") > b for n, above, b in rules[-1]])
        left = left.where(miss)
    return DecisionList(tuple(tuple(Condition(n, above, edges[n][b]) for n, above, b in r) for r in rules))


def sampled(labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The labels learned from: all, or about ``most_labelled`` of them, by a hash of the id."""
    count = labels.count()
    return labels if count <= most_labelled else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most_labelled / count))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base numbers and MORE, base_failed, rule (0: none), kept for every document; each is measured once."""
    measured = common.materialize(with_base(docs.select("doc_id", "text"), more=True).drop("text"))
    found = learn(measured, sampled(labels))
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", found.verdict())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that neither the base test nor the learned list rejects; the columns of docs. Documents are measured once, and
    those that the list is learned from once more."""
    labels = common.materialize(sampled(labels.select("doc_id", "quality")))
    # about MOST_LABELLED ids at most
    labelled = docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    found = learn(common.materialize(with_base(labelled, more=True).drop("text")), labels)
    rows = with_base(docs.select(F.struct("*").alias("doc"), "text"), more=True)
    # not a filter: one would be pushed below the base numbers, and work them out again for each use
    stays = F.explode(F.when(~base_failed() & (found.verdict() == 0), F.array(F.lit(0))))
    return rows.select("doc", stays).select("doc.*")
