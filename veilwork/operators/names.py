"""Names in running text, by sequence labels: what no shape or context vouches for.

A line is a sequence of tokens, each with a tag: outside, or the begin or inside of a kind. A tag's score at a token is the sum of the weights
of the token's features (shapes, endings and neighbours, never the word itself, so that unseen names count like seen ones), and a tag
follows another by a weight of its own. The best sequence comes from Viterbi's recursion; a span's score says by how much it beats
the best sequence without it.

Weights come from a structured perceptron, trained on spans that are known (such as the gazetteer's ground truth). Each pass trains every
partition from the same weights and averages what they have become, weighted by their lines, so all data is used and nothing is
gathered but FEATURES x tags sums, whose number does not depend on the data.

Cases: null and empty texts have no tokens; a text's lines are labelled apart, whole; spans that do not begin and end with a token are
widened to the tokens they touch; without training spans nothing is found; ties go to the earlier tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
FEATURES, PASSES = 1 << 15, 4


def shape(word: str) -> str:
    """X for capitals, x for small letters, 9 for digits, the mark itself for others; runs are one."""
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))


@lru_cache(1 << 16)
def numbered(first: bool, before: str, left: str, w: str, right: str, after: str) -> tuple[int, ...]:
    """The numbers of a token's features, from its neighbours; kept, as words in the same company come again and in each pass."""
    names = [f"s{shape(w)}", f"e{w[-2:].lower()}", f"p{left.lower()}", f"n{right.lower()}", f"P{shape(left)}|{shape(w)}", f"N{shape(w)}|{shape(right)}", f"q{before.lower()}", f"m{after.lower()}", f"{shape(left)}|{shape(w)}|{shape(right)}", f"f{first}|{shape(w)}", f"l{min(len(w), 9)}|{shape(w)}"]
    return tuple(xxhash.xxh32_intdigest(n) % FEATURES for n in names)


def featured(words: list[str]) -> np.ndarray:
    """The numbers of each token's features, a row a token."""
    at = ["<>", "<>", *words, "<>", "<>"]
    return np.array([numbered(i == 0, *at[i : i + 5]) for i in range(len(words))], np.int64).reshape(len(words), -1)


class Weights:
    """Of the tags ("O", and "B-" and "I-" of each kind): emissions FEATURES x tags, moves from tag to tag, and starts."""

    def __init__(self, kinds: list[str], packed: np.ndarray | None = None) -> None:
        self.kinds = kinds
        self.tags = ["O", *[f"{p}-{k}" for k in kinds for p in "BI"]]
        n = len(self.tags)
        self.packed = np.zeros(FEATURES * n + n * n + n) if packed is None else packed
        self.emit = self.packed[: FEATURES * n].reshape(FEATURES, n)
        self.move = self.packed[FEATURES * n : -n].reshape(n, n)
        self.start = self.packed[-n:]
        inside = np.array([t[0] == "I" for t in self.tags])
        follows = np.array([[b[0] != "I" or a != "O" and a[2:] == b[2:] for b in self.tags] for a in self.tags])
        self.barred, self.unbegun = np.where(follows, 0.0, -np.inf), np.where(inside, -np.inf, 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[x].sum(1)

    def forward(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token and tag, the best score of a sequence up to it, and the tag before."""
        best, back = np.empty_like(score), np.zeros(score.shape, int)
        best[0] = score[0] + self.start + self.unbegun
        moves = self.move + self.barred
        for i in range(1, len(score)):
            all_ = best[i - 1][:, None] + moves
            back[i] = all_.argmax(0)
            best[i] = all_.max(0) + score[i]
        return best, back

    def label(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, int)
        best, back = self.forward(self.scores(x))
        out = [int(best[-1].argmax())]
        for i in range(len(x) - 1, 0, -1):
            out.append(int(back[i][out[-1]]))
        return np.array(out[::-1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """For each token, by how much the best sequence beats the best one that has "O" there."""
        score = self.scores(x)
        best, _ = self.forward(score)
        rest = np.zeros_like(score)
        for i in range(len(score) - 2, -1, -1):
            rest[i] = (self.move + self.barred + (score[i + 1] + rest[i + 1])[None, :]).max(1)
        through = best + rest
        return through.max(1) - through[:, 0]

    def learn(self, x: np.ndarray, gold: np.ndarray, rate: float = 1.0) -> None:
        found = self.label(x)
        for i in np.flatnonzero(found != gold):
            np.add.at(self.emit, (x[i], gold[i]), rate)
            np.add.at(self.emit, (x[i], found[i]), -rate)
        if len(x):
            self.start[gold[0]] += rate
            self.start[found[0]] -= rate
            np.add.at(self.move, (gold[:-1], gold[1:]), rate)
            np.add.at(self.move, (found[:-1], found[1:]), -rate)


def lines_of(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The tokens (start, end, word) of each line that has some."""
    at = 0
    for line in text.split("\n"):
        found = [(at + m.start(), at + m.end(), m[0]) for m in TOKEN.finditer(line)]
        if found:
            yield found
        at += len(line) + 1


def tagged(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int, str]], tags: list[str]) -> np.ndarray:
    out = np.zeros(len(tokens), int)
    for start, end, kind in spans:
        hit = [i for i, (s, e, _) in enumerate(tokens) if s < end and start < e]
        for i in hit:
            out[i] = tags.index(("B-" if i == hit[0] else "I-") + kind)
    return out


def learned(docs: DataFrame, spans: DataFrame, kinds: list[str], passes: int = PASSES) -> Weights:
    """Weights from docs (doc_id, text) and their known spans (doc_id, start, end, kind)."""
    known = spans.where(F.col("kind").isin(*kinds)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    rows = docs.where("text is not null").select("doc_id", "text").join(known, "doc_id", "left").select("text", "spans").sortWithinPartitions(F.xxhash64("text")).persist()  # in a fixed order, as training depends on it
    weights = Weights(kinds)
    for _ in range(passes):
        before = weights.packed

        def train(batches: Iterator[pd.DataFrame], before: np.ndarray = before) -> Iterator[pd.DataFrame]:
            own, total, lines = Weights(kinds, before.copy()), np.zeros_like(before), 0
            for b in batches:
                for text, known_ in zip(b["text"], b["spans"], strict=True):
                    given = [(s["start"], s["end"], s["kind"]) for s in (known_ if known_ is not None else ())]
                    for tokens in lines_of(text):
                        own.learn(featured([t[2] for t in tokens]), tagged(tokens, given, own.tags))
                        total += own.packed if lines % 16 == 0 else 0
                        lines += 1
            if lines:
                some = np.flatnonzero(total)
                yield pd.DataFrame({"at": some, "weight": total[some] * lines / -(-lines // 16), "lines": lines})

        sums = rows.mapInPandas(train, "at long, weight double, lines long").persist()
        # a partition's rows all have its number of lines: the marker of its largest place counts it once
        table = sums.groupBy("at").agg(F.sum("weight").alias("weight")).toArrow()
        total = rows.count() and sums.groupBy(F.spark_partition_id()).agg(F.max("lines").alias("lines")).agg(F.sum("lines")).first()[0] or 1
        packed = np.zeros_like(before)
        packed[table.column("at").to_numpy()] = table.column("weight").to_numpy() / total
        sums.unpersist()
        weights = Weights(kinds, packed)
    rows.unpersist()
    return weights


def findings(docs: DataFrame, weights: Weights, id_col: str = "doc_id") -> DataFrame:
    """One row for each span found: id_col, kind, start, end, value, score (0.5 to 1, by its least margin), as ``detect.findings``."""
    kinds, packed = weights.kinds, weights.packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = Weights(kinds, packed), [id_col, "kind", "start", "end", "value", "score"]
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for tokens in lines_of(text):
                    x = featured([t[2] for t in tokens])
                    tags = model.label(x)
                    if not tags.any():
                        continue
                    margin = model.margins(x)
                    begins = [k for k in np.flatnonzero(tags) if model.tags[tags[k]][0] == "B"]
                    for k in begins:
                        end = k + 1
                        while end < len(tags) and model.tags[tags[end]][0] == "I":
                            end += 1
                        start, stop = tokens[k][0], tokens[end - 1][1]
                        out.append((i, model.tags[tags[k]][2:], start, stop, text[start:stop], float(1 / (1 + np.exp(-margin[k:end].min())))))
            types = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types, strict=True)], names)

    return docs.where("text is not null").select(id_col, "text").mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, kind string, start int, end int, value string, score double")


def agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, precision, recall, n (of the truth): spans that agree in document, kind, start and end."""
    key = ["doc_id", "kind", "start", "end"]
    both = found.select(*key, F.lit(1).alias("f")).join(truth.select(*key, F.lit(1).alias("t")), key, "full")
    hit = F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull())
    return both.groupBy("kind").agg(F.try_divide(hit, F.count("f")).alias("precision"), F.try_divide(hit, F.count("t")).alias("recall"), F.count("t").alias("n"))
