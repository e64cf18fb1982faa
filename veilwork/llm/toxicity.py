"""Toxicity: maximum-scoring segments of token log-odds.

Learning. Tokens (lower-cased runs of letters, digits and _) are counted by label in the training rows, once a text. A
token's score is the difference of its log-odds in toxic and in clean texts under an informative Dirichlet prior (the
counts of both together, scaled to PRIOR texts, and FLAT more); tokens whose z is below LEAST_Z score 0. Each token also costs DRIFT, so that a
passage ends where nothing more speaks for it.

Scoring. One linear scan (Ruzzo and Tompa's) finds all maximal scoring segments of a text. In texts without toxic
passages a segment of score S turns up with a rate of K N exp(-lambda S) in N tokens (extreme-value statistics): lambda
solves the moment equation of the clean token scores, K is set by the rate seen in clean training texts. Segments rarer than
EVALUE in their text are significant; a text's evidence is the sum of their -log of that rate. A logistic curve, fitted
on histograms of the training rows' evidence, gives the probability.

Cases: null text counts as empty; empty texts have no evidence and the score of no evidence; null labels are left out;
ids with several labels count with each; without both labels among the training rows every score is the share of toxic
rows (0 without rows); repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm import common

PRIOR, FLAT, LEAST_Z, LEAST_DOCS, DRIFT, EVALUE = 10.0, 0.5, 3.0, 5, 0.05, 0.5
#: Labelled rows learned from, at most, chosen by a hash of the id: bounds the model, which is sent to all tasks.
MOST_LABELLED = 500_000
TOKEN = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(scores: list[tuple[int, float]], size: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a text of ``size`` tokens.

    scores: position and score of the tokens that do not score 0; every token costs drift. Between these the sum only
    falls, so the scan needs no more than them. The stack holds candidates with the sums left and right of them.
    """
    found: list[list[float]] = []  # begin, end, left sum, right sum
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        left, total, at = total, total + s - drift, i + 1
        if s <= drift:
            continue
        new = [i, i + 1, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(b), int(e), r - le) for b, e, le, r in found]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    base: float = 0.0
    fixed: float | None = 0.0
    drift: float = DRIFT

    def known(self, words: list[str]) -> list[tuple[int, float]]:
        """Position and score of the tokens that do not score 0."""
        return [(i, s) for i, w in enumerate(words) if (s := self.scores.get(w))]

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments, as token positions, with their evidence."""
        words = tokens(text)
        known = self.known(words)
        if not known:
            return []
        tail = log(self.k * len(words)) if self.k * len(words) > 0 else 0.0
        return [(b, e, x) for b, e, s in segments(known, len(words), self.drift) if (x := self.rate * s - tail) > -log(EVALUE)]

    def evidence(self, text: str) -> float:
        return sum(x + log(EVALUE) + 0.1 for _, _, x in self.passages(text))

    def probability(self, evidence: float) -> float:
        if self.fixed is not None:
            return self.fixed
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.base + self.slope * evidence))))


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """docs: the training rows (doc_id, text); labels: doc_id, toxic."""
    common.small_batches(docs.sparkSession)
    labels = labels.where("toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    count = labels.count()
    rows = docs.select("doc_id", common.text_of().alias("text")).where("doc_id is not null")
    if count > most_labelled:
        taken = lambda of: F.pmod(F.xxhash64(of), F.lit(1_000_003)) < int(1_000_003 * most_labelled / count)
        rows, labels = rows.where(taken("doc_id")), labels.where(taken(F.col("_id").cast(dict(rows.dtypes)["doc_id"])))
    labels = common.materialize(labels.withColumnRenamed("_id", "doc_id").dropDuplicates())
    rows = common.materialize(common.lookup_join(rows, labels, "doc_id").select("text", "toxic"))

    def count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                seen[toxic].update(set(tokens(text)))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield table(seen)
                seen = [Counter(), Counter()]
        yield table(seen)

    def table(seen: list[Counter]) -> pd.DataFrame:
        return pd.DataFrame([(w, seen[1][w], seen[0][w]) for w in seen[0].keys() | seen[1].keys()], columns=["w", "bad", "good"])

    counted = rows.mapInPandas(count_tokens, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    of = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad, good = of.get(1, 0), of.get(0, 0)
    if not (bad and good):
        return Model(fixed=bad / max(1, bad + good))
    both = F.col("bad") + F.col("good")
    prior = both / F.lit(float(bad + good)) * F.lit(PRIOR) + F.lit(FLAT)
    odds = lambda n, total: F.log((F.col(n) + prior) / (F.lit(total + PRIOR + 2 * FLAT) - F.col(n) - prior))
    scored = counted.where(both >= LEAST_DOCS).withColumn("s", odds("bad", bad) - odds("good", good)).withColumn("z", F.col("s") / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior)))
    # a bounded table: tokens that the bounded training rows hold often enough to be told from chance
    chosen = scored.where(F.col("z") >= LEAST_Z).select("w", "s", "good").collect()
    n_tokens = rows.where("toxic = 0").agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 1
    model = Model({r["w"]: r["s"] for r in chosen}, fixed=None)
    # lambda: the root of the mean of exp(lambda * score) = 1 over clean tokens
    scores = np.array([r["s"] for r in chosen] + [0.0]) - DRIFT
    weight = np.array([max(r["good"], FLAT) for r in chosen] + [0.0])
    weight[-1] = max(1.0, n_tokens - weight.sum())
    weight /= weight.sum()
    low, high = 0.0, 20.0
    if (weight * scores).sum() < 0 and len(scores) > 1:
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (weight * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (low, mid)
        model.rate = max(low, 1e-3)
    model.k = rate_of_clean(rows, model)
    fit(rows, model)
    return model


def rate_of_clean(rows: DataFrame, model: Model) -> float:
    """K: segments of clean training texts a token, times exp(lambda * score), on average over their excess."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, seen, least = 0, 0, float("inf")
            found = []
            for text in b["text"]:
                words = tokens(text)
                n += len(words)
                found += [s for _, _, s in segments(model.known(words), len(words), model.drift)]
            yield pd.DataFrame({"n": [n], "seen": [len(found)], "least": [min(found, default=least)]})

    n, seen, least = rows.where("toxic = 0").mapInPandas(each, "n long, seen long, least double").agg(F.sum("n"), F.sum("seen"), F.min("least")).first()
    if not n or not seen:
        return 1e-6
    return max(1e-9, min(1.0, seen / n * exp(min(50.0, model.rate * least))))


def fit(rows: DataFrame, model: Model) -> None:
    """The logistic curve, by Newton's method on counts of toxic and clean rows by evidence in steps of 0.25."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"step": [int(min(400, 4 * model.evidence(t))) for t in b["text"]], "toxic": b["toxic"]})

    counts = rows.mapInPandas(each, "step int, toxic int").groupBy("step").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).collect()
    x = np.array([r["step"] / 4 for r in counts])
    y, n = (np.array([float(r[c]) for r in counts]) for c in ("bad", "all"))
    a, b = log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(y - n * p).sum(), ((y - n * p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.base, model.slope = float(a), float(max(b, 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (begin and end in tokens, evidence) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see MOST_LABELLED
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            found = [m.passages(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [m.probability(sum(x + log(EVALUE) + 0.1 for _, _, x in f)) for f in found], "passages": [[{"begin": p, "end": q, "evidence": x} for p, q, x in f] for f in found]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), common.text_of().alias("text"))
    out = rows.mapInPandas(each, "doc_id string, score double, passages array<struct<begin:int,end:int,evidence:double>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
