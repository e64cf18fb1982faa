"""Hard-negative mining: product quantisation with stored residual norms.

Vectors become integers, floor(256 x) in each component; a score is the integer inner product. Each pair of components is
quantised to one of CENTROIDS integer centroids, so a vector is a short code, and the norm of what the code leaves out (its
residual) is stored beside it. For an anchor q, lookup tables give the score of every code; by Cauchy and Schwarz the true score is
within |q| times the residual's norm of it. These bounds say, for each block of rows, which rows can be among the best ones that
are sought; only these are scored exactly, from their integers, so the result is exact however coarse the codes are.

1. The codebooks are fitted on at most FITTED rows, chosen by a hash of the id; every row is indexed.
2. Rows are stored in blocks of ROWS (ids, labels, integers, codes, norms), anchors in blocks of ANCHORS. The two kinds of block
   meet in a join over shards: a row for each pair of blocks, so that a task holds one pair at a time. Anchors are a set of queries,
   held against all rows, in blocks.
3. Positives: a pair of blocks gives the best rows of the anchor's label; the best of these over all blocks are the anchor's.
4. Negatives: with its positives' scores known, each anchor has a window of scores for each; a pair of blocks gives the best rows of
   other labels in each window, and the best of these over all blocks complete it.

Cases: rows with a null label, a null vector, or any null or non-finite component take no part; a null vec_id sorts after all others
and is no anchor; missing components count as zeros, so vectors of unlike lengths, or empty ones, have scores; ties go to the smaller
vec_id; repeated rows count as often as they occur, but a row with the anchor's own vec_id is never its positive; an anchor that occurs
twice is answered twice; a window below zero is empty; scores beyond the range of a long count as its
limits; an empty table gives an empty result; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veilwork.llm import common

SCALE = 256
WIDTH, CENTROIDS, FITTED, ROUNDS = 2, 256, 4096, 6
ROWS, ANCHORS, AT_ONCE, SCORED = 2048, 1024, 64, 1 << 16
SHARDS = 4096
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
NO_ID = np.iinfo("int64").max
SURE = float(1 << 45)  # sums of products below this are exact in float64, times 100 too


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding (doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.where("label is not null and embedding is not null").where(~bad).select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def padded(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """floor(256 x) of a column of lists, a row each, zeros where a list is shorter."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max([dims, *size.tolist()])))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    return out


def fit(x: np.ndarray) -> np.ndarray:
    """Codebooks of the columns of x, WIDTH at a time: parts x centroids x WIDTH, whole numbers."""
    rng = np.random.default_rng(13)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
    books = []
    for part in range(x.shape[1] // WIDTH):
        own = x[:, part * WIDTH : part * WIDTH + WIDTH]
        book = np.unique(own, axis=0)
        if len(book) > CENTROIDS:
            book = rng.permutation(book)[:CENTROIDS]
            for _ in range(ROUNDS):
                near = nearest(own, book)
                count = np.bincount(near, minlength=len(book))
                sums = np.stack([np.bincount(near, own[:, i], len(book)) for i in range(WIDTH)], 1)
                book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        book = np.rint(book)
        books.append(np.pad(book, ((0, CENTROIDS - len(book)), (0, 0)), mode="edge"))
    return np.stack(books) if books else np.zeros((0, CENTROIDS, WIDTH))


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)


def quantised(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, rows x parts, and an upper bound of the residuals' norms."""
    parts = np.pad(x, ((0, 0), (0, max(0, len(books) * WIDTH - x.shape[1]))))
    codes, rest = np.zeros((len(x), len(books)), np.uint8), parts.copy()
    for part, book in enumerate(books):
        columns = slice(part * WIDTH, part * WIDTH + WIDTH)
        codes[:, part] = nearest(parts[:, columns], book)
        rest[:, columns] -= book[codes[:, part]]
    return codes, norms(rest)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1)) * (1 + 1e-9)


def blocks(rows: DataFrame, most: int, make: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> DataFrame:
    """A written table with a row for each most rows: no, block (the arrays that make gives, as bytes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            to = BytesIO()
            np.savez(to, **make(batch))
            return pa.RecordBatch.from_arrays([pa.array([to.getvalue()], pa.binary())], ["block"])

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= most:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield one(whole.slice(0, most).to_batches()[0])
                held = whole.slice(most).to_batches()
        if sum(map(len, held)):
            yield one(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return common.materialize(rows.mapInArrow(pack, "block binary").select(F.monotonically_increasing_id().alias("no"), "block"))


def ids_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(NO_ID).to_numpy().astype(np.int64)


def small(x: np.ndarray) -> np.ndarray:
    """The whole numbers x in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def indexed(rows: DataFrame, books: np.ndarray) -> DataFrame:
    def make(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        labels = b.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        x = padded(b.column("embedding"))[order]
        codes, norm = quantised(x, books)
        return {"ids": ids_of(b, "vec_id")[order], "labels": labels[order], "x": small(x), "codes": codes, "norm": norm}

    return blocks(rows, ROWS, make)


def packed_anchors(anchors: DataFrame) -> DataFrame:
    """anchors: anchor (its number), vec_id, label, embedding, positives (array of struct<id, score>, best first; may be missing)."""

    def make(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        order = np.argsort(labels := b.column("label").to_numpy(), kind="stable")
        out = {"anchor": ids_of(b, "anchor")[order], "ids": ids_of(b, "vec_id")[order], "labels": labels[order], "x": padded(b.column("embedding"))[order]}
        if "positives" in b.schema.names:
            lists = b.column("positives").to_pylist()
            for k, empty in (("id", NO_ID), ("score", -1)):
                out[k] = np.array([[NO_ID if p[k] is None else p[k] for p in lists[i]] + [empty] * (POSITIVES - len(lists[i])) for i in order], np.int64).reshape(-1, POSITIVES)
        return out

    return blocks(anchors, ANCHORS, make)


def paired(index: DataFrame, anchors: DataFrame, work: Callable[[dict, dict], list[np.ndarray]], schema: str) -> DataFrame:
    """work(block of rows, block of anchors) for every pair of blocks; it gives columns of whole numbers, in the order of schema."""
    common.small_batches(index.sparkSession)
    shards = max(1, min(SHARDS, index.count()))
    rows = index.select(F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int").alias("shard"), "block").repartition(shards, "shard")
    queries = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("block").alias("asked")).repartition(shards, "shard")
    names = [x.split()[0] for x in schema.split(", ")]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, asked in zip(b.column("block"), b.column("asked"), strict=True):
                got = work(*(dict(np.load(BytesIO(x.as_py()))) for x in (block, asked)))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=c == NO_ID) for c in got], names)

    return rows.join(queries, "shard").select("block", "asked").mapInArrow(pairs, schema)


def bounds(q: np.ndarray, books: np.ndarray, codes: np.ndarray, norm: np.ndarray, sure: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every row of codes for every anchor of q."""
    if not sure:  # float64 would round: no row is left out
        return np.full((len(q), len(codes)), -np.inf), np.full((len(q), len(codes)), np.inf)
    q2 = np.pad(q, ((0, 0), (0, max(0, len(books) * WIDTH - q.shape[1]))))
    score = np.zeros((len(q), len(codes)))
    for part, book in enumerate(books):
        score += np.take(q2[:, part * WIDTH : part * WIDTH + WIDTH] @ book.T, codes[:, part], axis=1)
    error = np.outer(norms(q), norm) * (1 + 1e-9)
    return score - error, score + error


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, j: np.ndarray, sure: bool) -> np.ndarray:
    """Inner products of anchors a and rows j, as whole numbers (objects where float64 might round)."""
    d = min(q.shape[1], x.shape[1])
    out = []
    for i in range(0, len(a), SCORED):
        p, r = q[a[i : i + SCORED], :d], x[j[i : i + SCORED], :d]
        out.append(np.einsum("ij,ij->i", p, r.astype(float)).astype(np.int64) if sure else np.array([max(1 - NO_ID, min(NO_ID - 1, sum(int(u) * int(v) for u, v in zip(s, t, strict=True)))) for s, t in zip(p, r, strict=True)], object))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def first(order: list[np.ndarray], group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first most of each group, by order (the last key counts most)."""
    order = [np.unique(k, return_inverse=True)[1] if k.dtype == object else k for k in order]
    at = np.lexsort([*order, group])
    g = group[at]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return at[rank < most]


def kth(low: np.ndarray, most: int) -> np.ndarray:
    """Of each row, the most-th greatest value; less than any where there are fewer."""
    return np.partition(low, low.shape[1] - most, axis=1)[:, low.shape[1] - most] if low.shape[1] >= most else np.full(len(low), -np.inf)


def is_sure(rows: dict, asked: dict) -> bool:
    return float(np.abs(rows["x"].astype(float)).max(initial=0)) * float(np.abs(asked["x"]).max(initial=0)) * max(rows["x"].shape[1], asked["x"].shape[1]) < SURE


def best_positives(books: np.ndarray, most: int) -> Callable[[dict, dict], list[np.ndarray]]:
    def work(rows: dict, asked: dict) -> list[np.ndarray]:
        sure, out = is_sure(rows, asked), []
        for label in np.unique(asked["labels"]):
            mine = np.flatnonzero(asked["labels"] == label)
            lo, hi = np.searchsorted(rows["labels"], [label, label + 1])
            ids, x = rows["ids"][lo:hi], rows["x"][lo:hi]
            for i in range(0, len(mine) if lo < hi else 0, AT_ONCE):
                some = mine[i : i + AT_ONCE]
                q = asked["x"][some]
                low, high = bounds(q, books, rows["codes"][lo:hi], rows["norm"][lo:hi], sure)
                other = asked["ids"][some][:, None] != ids[None, :]
                low[~other] = -np.inf
                a, j = np.nonzero(other & (high >= kth(low, most)[:, None]))
                score = exact(q, x, a, j, sure)
                keep = first([ids[j], -score], a, most)
                out.append([asked["anchor"][some[a[keep]]], ids[j[keep]], score[keep].astype(np.int64)])
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3

    return work


def best_negatives(books: np.ndarray, most: int, low_percent: int, high_percent: int) -> Callable[[dict, dict], list[np.ndarray]]:
    def work(rows: dict, asked: dict) -> list[np.ndarray]:
        sure, out = is_sure(rows, asked), []
        ids, x = rows["ids"], rows["x"]
        for i in range(0, len(asked["ids"]), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            q, goal, of = asked["x"][some], asked["score"][some], asked["id"][some]
            low, high = bounds(q, books, rows["codes"], rows["norm"], sure)
            other = asked["labels"][some][:, None] != rows["labels"][None, :]
            wanted = []
            for k in range(goal.shape[1]):
                top, floor = (goal[:, k, None] * float(high_percent) / 100, goal[:, k, None] * float(low_percent) / 100)
                certain = kth(np.where(other & (low >= floor) & (high <= top), low, -np.inf), most)
                wanted.append(other & (goal[:, k, None] >= 0) & (high >= np.maximum(floor, certain[:, None]) - 1) & (low <= top + 1))
            a, j = np.nonzero(np.any(wanted, axis=0))
            score = exact(q, x, a, j, sure)
            for k in range(goal.shape[1]):
                goal_k = goal[a, k] if score.dtype != object else goal[a, k].astype(object)
                inside = (goal[a, k] >= 0) & (low_percent * goal_k <= 100 * score) & (100 * score <= high_percent * goal_k)
                at = np.flatnonzero(inside.astype(bool))
                keep = at[first([ids[j[at]], -score[at]], a[at], most)]
                out.append([asked["anchor"][some][a[keep]], np.full(len(keep), k), of[a[keep], k], goal[a[keep], k], ids[j[keep]], score[keep].astype(np.int64)])
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6

    return work


def best(rows: DataFrame, keys: list[str], id_: str, score: str, most: int) -> DataFrame:
    """The first most rows of each key by score, ties by the smaller id, with rank from 1. Spark limits each task's rows first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(id_))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows: vec_id, label, embedding, as ``taking_part`` gives; is_anchor: a condition on vec_id. Gives anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score: the first negatives rows of another label with low <= 100 score / positive score <= high."""
    spark = rows.sparkSession
    count = rows.count()
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count // FITTED))) == 0).select("embedding").limit(FITTED)
    sample = sampled.toArrow().column("embedding").combine_chunks()
    books = fit(padded(sample)) if count else np.zeros((0, CENTROIDS, WIDTH))
    index = indexed(rows, books)
    anchors = common.materialize(rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "embedding"))
    found = paired(index, packed_anchors(anchors), best_positives(books, positives), "anchor long, id long, score long")
    goals = best(found, ["anchor"], "id", "score", positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asked = packed_anchors(anchors.join(goals, "anchor").select("anchor", "vec_id", "label", "embedding", "positives"))
    found = paired(index, asked, best_negatives(books, negatives, low, high), "anchor long, k long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = best(found, ["anchor", "k"], "negative_id", "negative_score", negatives)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
