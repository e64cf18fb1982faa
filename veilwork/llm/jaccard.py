"""N-gram Jaccard join over count vectors.

A document's set is its distinct n-word shingles (as 64-bit names); documents link when percent * union <= 100 *
intersection. The join gives classes of equal sets, and links between their representatives.

1. Equal sets become one class, so copies cost one row each.
2. Blocks. Shingles are ordered by how often their bucket occurs (2^BUCKETS counts over all documents), rare first.
   Two linked sets share one of the first n - ceil(percent * n / 100) + 1 shingles of each in this order, so a class is
   posted under those only. Any order is exact; rare first keeps blocks small.
3. Vectors. A class's shingles are hashed to GROUPS groups; the group counts are its point. The overlap of two sets is at
   most the sum of the coordinate minima of their points. A block's classes are dealt into leaves of about LEAF by size and
   name, from counts that Spark sums; leaves whose sizes allow a link meet in tasks of their own, so no task holds a block. There
   one side's points are packed, by size and by their largest coordinates, into an R-tree whose nodes hold the greatest counts
   and the sizes below them; the other side's points descend it, level by level, and leave a node whose bound is below the
   needed overlap. The prefix blocks only deal the work out: they are exact, and a tree over all points would be one task.
4. Verification of the surviving pairs against the sets.

Links are found in two rounds. First each class meets its blocks' heaviest class (that of most documents); what these
link is one component already. Then only pairs of different components meet. So a group of thousands of near copies costs a few
pairs for each copy instead of all pairs, and components are the same, as no link between components is left out.

Cases: null text, and texts without words, have an empty set and no links; with fewer words than n, the whole sequence is
the one shingle; rows that share an id are judged each by its own text; null ids have their class's component, and are
the least id of none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilwork.llm import common

BUCKETS, PARTS = 18, 64
GROUPS, COARSE = 256, 64
LEAF, FAN = 4096, 8  # classes of a block that meet in one task, of each of two sides; children of a node of the tree
PAIRS = 1 << 13  # pairs of classes whose counts are held at once
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S = np.uint64(29)
WORDS = 1 << 18  # words whose names a worker remembers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K1
    return x ^ (x >> S)


class Namer(dict):
    """Names of words, remembered up to WORDS of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, n: int, names: Namer) -> np.ndarray:
    """The sorted distinct shingle names of a text; A-Z is lower-cased, words end at U+0020 and U+0009..U+000D."""
    return np.unique(all_shingles(text, n, names))


def all_shingles(text: str, n: int, names: Namer) -> np.ndarray:
    """A name for each shingle, repeats included."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, "u8")
    w = np.fromiter(map(names.__getitem__, found), "u8", len(found))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, "u8")
    for i in range(k):
        h = mixed(h * K2 + w[i : len(w) - k + 1 + i])
    return h


def buckets_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKETS)).astype("i8")


def bucket_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles by bucket, counted over all documents: 2^BUCKETS numbers, whatever the size of the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(1 << BUCKETS, "i8"), Namer()
        for b in batches:
            held, size = [], 0
            for t in b.column("text"):
                held.append(all_shingles(t.as_py() or "", n, names))
                size += len(held[-1])
                if size > 1 << 20:
                    total += np.bincount(buckets_of(np.concatenate(held)), minlength=1 << BUCKETS)
                    held, size = [], 0
            if held:
                total += np.bincount(buckets_of(np.concatenate(held)), minlength=1 << BUCKETS)
        # packed by part of the range, so that parts are added in several tasks
        for part, x in enumerate(np.split(total, PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.astype("i8").tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; a task holds one part's sums, whatever the number of rows."""
        at, total = None, None
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("counts")):
                if part != at:
                    if at is not None:
                        yield packed()
                    at, total = part, np.zeros((1 << BUCKETS) // PARTS, "i8")
                total += np.frombuffer(x.as_py(), "i8")
        if at is not None:
            yield packed()

    schema = "part int, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema).orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["counts"], "i8") for r in rows]) if rows else np.zeros(1 << BUCKETS, "i8")


def profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n (set size), node (name of the set), vector (GROUPS counts, packed), prefix (shingle names)."""
    # half a MB; loads beyond 16 bits count as equal, which only moves the order within the commonest
    load = docs.sparkSession.sparkContext.broadcast(np.minimum(bucket_counts(docs, n), (1 << 16) - 1).astype("u2"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Namer()
        for b in batches:
            size, node, vector, prefix = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py() or "", n, names)
                size.append(len(s))
                node.append(name_of(s))
                counts = np.bincount((s & np.uint64(GROUPS - 1)).astype("i8"), minlength=GROUPS)
                vector.append(counts.astype("u1" if counts.max() < 256 else "<u4").tobytes())
                first = len(s) - -(-percent * len(s) // 100) + 1
                prefix.append(s[np.argsort(load.value[buckets_of(s)], kind="stable")[:first]].view("i8") if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(vector, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "n", "node", "vector", "prefix"])

    return docs.select("id", "text").mapInArrow(profile, "id long, n long, node long, vector binary, prefix array<long>")


def vectors_of(column: pa.Array) -> np.ndarray:
    """Packed vectors as rows; counts take one byte each, or four where one of them is large."""
    packed = column.to_pylist()
    if all(len(x) == GROUPS for x in packed):
        return np.frombuffer(b"".join(packed), "u1").reshape(-1, GROUPS).astype("i4")
    return np.stack([np.frombuffer(x, "u1" if len(x) == GROUPS else "<u4").astype("i4") for x in packed])


def name_of(s: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), "i8")[0])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link. Each b's set is sent to a's; a's set is held while its partners stream by.

    The sets are made again from the texts of the classes' least ids, of the nodes in pairs only; those of classes whose
    rows all have a null id, from the rows with a null id, by the set's name.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select(F.col("least").alias("id"), "node")
    wanted = common.materialize(wanted)
    texts = common.lookup_join(docs.select("id", "text"), wanted, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Namer()
        for b in batches:
            made = ((node, shingles(t.as_py() or "", n, names)) for node, t in zip(b.column("node").to_pylist(), b.column("text")))
            rows = [(name, s.tobytes()) for node, s in made if (name := name_of(s)) == node or node is None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "s"])

    sets = texts.mapInArrow(pack, "id long, s binary")
    nameless = wanted.where("id is null").select(F.col("node").alias("id"))
    if not nameless.isEmpty():
        made = docs.where("id is null").select("text", F.lit(None).cast("long").alias("node")).mapInArrow(pack, "id long, s binary")
        sets = sets.unionByName(common.lookup_join(made, nameless, "id"))
    sets = common.materialize(sets.dropDuplicates(["id"]))
    # a hub's partners are dealt into lots, each with a copy of the hub's set
    lots = pairs.withColumn("lot", F.pmod(F.xxhash64("b"), F.lit(64)))
    hubs = lots.select("a", "lot").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "lot", F.lit(None).cast("long").alias("b"), "s")
    partners = lots.join(sets.withColumnRenamed("id", "b"), "b").select("a", "lot", "b", "s")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for t in batches:
            out = []
            for a, lot, b, s in zip(*[t.column(c).to_pylist() for c in ("a", "lot", "b", "s")]):
                s = np.frombuffer(s, "u8")
                if b is None:
                    at, hub = (a, lot), s
                    continue
                assert at == (a, lot)
                both = np.concatenate([hub, s])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(hub) + len(s) - shared):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return hubs.unionByName(partners).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long")


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima reach the needed overlap."""
    one, two = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}")) for x in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            va, vb = (vectors_of(t.column(c)) for c in ("v_a", "v_b"))
            need = percent * (t.column("n_a").to_numpy() + t.column("n_b").to_numpy()) / (100 + percent) - 1e-6
            yield t.select(["a", "b"]).filter(pa.array(np.minimum(va, vb).sum(1) >= need))

    return pairs.join(one, "a").join(two, "b").mapInArrow(bound, "a long, b long")


def block_pairs(posted: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a block and that the bounds let through.

    posted: token, node, n, component, a written table; vectors: node, vector. Sizes fall into steps a little wider than two
    linked sets may differ by, so links are within a step or between neighbours; a step's classes are dealt by name into leaves of
    about LEAF; two leaves that may have links are a task's unit.
    """
    step = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9)).cast("long")
    several = posted.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("token")
    rows = common.materialize(common.written_join(posted, common.materialize(several), "token").withColumn("step", step))
    steps = rows.groupBy("token", "step").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("lanes"), F.count("*").alias("count"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    steps = common.materialize(steps)
    other = F.explode(F.array("step", F.col("step") + 1)).alias("step_b")
    upper = steps.select("token", F.col("step").alias("step_b"), *[F.col(c).alias(f"{c}_b") for c in ("lanes", "c0", "c1")])
    same = F.col("step") == F.col("step_b")
    differ = ~((F.col("c0") == F.col("c1")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0") == F.col("c0_b")))
    near = steps.select("*", other).join(upper, ["token", "step_b"]).where(differ & (~same | (F.col("count") > 1)))
    leaf = lambda step, lane: F.col(step) * F.lit(1 << 32) + F.col(lane)
    lanes = near.select("*", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("i")).select("*", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(F.lit(0)), F.col("lanes_b") - 1)).alias("j"))
    meets = lanes.select("token", leaf("step", "i").alias("x"), leaf("step_b", "j").alias("y"))
    sides = common.materialize(meets.select("token", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("leaf")))
    dealt = rows.join(steps.select("token", "step", "lanes"), ["token", "step"]).withColumn("lane", F.pmod(F.xxhash64("node"), F.col("lanes"))).withColumn("leaf", leaf("step", "lane"))
    met = common.materialize(dealt.select("token", "leaf", "node", "n", "component")).join(sides, ["token", "leaf"]).join(vectors, "node").select("token", "x", "y", "leaf", "node", "n", "component", "vector")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ("token", "x", "y")):
            leaf, x, y, node, n, comp = (block.column(c).to_numpy() for c in ("leaf", "x", "y", "node", "n", "component"))
            v = vectors_of(block.column("vector"))
            for a, b in tree_pairs(v, n, comp, np.flatnonzero(leaf == x), np.flatnonzero(leaf == y), x[0] == y[0], percent):
                yield pa.RecordBatch.from_arrays([pa.array(f(node[a], node[b])) for f in (np.minimum, np.maximum)], names=["a", "b"])

    return met.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(meet, "a long, b long").distinct()


def blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        cut = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:]):
            if held and any(held[0].column(k)[0].as_py() != c[i] for k, c in zip(keys, cols)):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass(frozen=True)
class Level:
    """The nodes of one level of the tree: greatest counts below each, least and greatest size, and the children (from, to) on the
    level below."""

    high: np.ndarray
    least: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def packed_tree(coarse: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """The points in packing order, and the levels from the root down; the last level's children are points.

    Points are packed by size, in runs of FAN nodes, and in a run by the coordinates that vary most: near points are near.
    """
    wide = np.argsort(-coarse.var(0), kind="stable")[:4]
    run = np.argsort(np.argsort(n, kind="stable"), kind="stable") // (FAN * FAN)
    order = np.lexsort((n, *coarse[:, wide[::-1]].T, run))
    high, least, most = coarse[order], n[order], n[order]
    levels: list[Level] = []
    while not levels or len(high) > 1:
        begin = np.arange(0, len(high), FAN)
        end = np.minimum(begin + FAN, len(high))
        high, least, most = np.maximum.reduceat(high, begin, axis=0), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)
        levels.append(Level(high, least, most, begin, end))
    return order, levels[::-1]


def overlaps(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of the coordinate minima of rows p of a and rows q of b, PAIRS at once: near copies leave a million pairs, of 1 KB a side."""
    out = np.zeros(len(p), "i8")
    for k in range(0, len(p), PAIRS):
        np.minimum(a[p[k : k + PAIRS]], b[q[k : k + PAIRS]]).sum(1, out=out[k : k + PAIRS])
    return out


def tree_join(v, n, comp, one, two, same, percent, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``tree_pairs`` at once."""
    none = np.zeros(0, "i8")
    return tuple(np.concatenate([none, *x]) for x in zip((none, none), *tree_pairs(v, n, comp, one, two, same, percent, at_once)))


def tree_pairs(v, n, comp, one, two, same, percent, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different components whose bound reaches the needed overlap: the points of one side descend the tree of the
    other, some at once; points that are left are held against each other by coarse, then by all groups."""
    need = lambda p, q: percent * (p + q) / (100 + percent) - 1e-6  # noqa: E731  of overlap, for sizes p and q
    if not len(one) or not len(two):
        return
    coarse = v.reshape(len(v), COARSE, -1).sum(2)
    order, levels = packed_tree(coarse[two], n[two])
    two = two[order]
    for k in range(0, len(one), at_once):
        mine = one[k : k + at_once]
        p, node = np.repeat(mine, len(levels[0].least)), np.tile(np.arange(len(levels[0].least)), len(mine))
        for level in levels:
            fits = (100 * level.most[node] >= percent * n[p]) & (100 * n[p] >= percent * level.least[node])
            p, node = p[fits], node[fits]
            fits = overlaps(level.high, node, coarse, p) >= need(n[p], np.maximum(level.least[node], -(-percent * n[p] // 100)))
            p, node = p[fits], node[fits]
            size = level.end[node] - level.begin[node]
            p, node = np.repeat(p, size), np.repeat(level.begin[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        q = two[node]
        fits = (comp[q] != comp[p]) & ((q > p) | (not same))
        p, q = p[fits], q[fits]
        for points in (coarse, v):
            fits = overlaps(points, p, points, q) >= need(n[p], n[q])
            p, q = p[fits], q[fits]
        yield p, q


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id (doc_id) and n_shingles of every row, and node, the name of its set; links: a, b:
    links between nodes which connect all that the full join connects."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    profile = common.materialize(profiles(docs, n, percent))
    rows = common.materialize(profile.select("id", "n", "node"))
    classes = profile.where("n > 0").groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first(F.struct("n", "vector", "prefix")).alias("x"))
    classes = common.materialize(classes.select("node", "weight", "least", "x.*"))
    common.discard(profile)
    posted = classes.select("node", "n", "weight", F.explode("prefix").alias("token"))
    # most tokens are one class's alone; only the others are looked at further, with the heaviest class of each
    heavy = F.max(F.struct("weight", "node", "n")).alias("h")
    tokens = posted.groupBy("token").agg(F.count("*").alias("count"), heavy).where("count > 1").select("token", "count", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
    shared = common.materialize(common.written_join(posted, common.materialize(tokens), "token"))
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    first = shared.where((F.col("node") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = common.materialize(verified(common.materialize(bounded(first, classes, percent)), docs, classes, n, percent))
    known = common.components(links).select(F.col("id").alias("node"), "component")
    open_rows = shared.where("count > 2").join(known, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("component"))
    second = common.materialize(block_pairs(common.materialize(open_rows), classes.select("node", "vector"), percent))
    links = common.materialize(links.unionByName(verified(second, docs, classes, n, percent)))
    return rows.select("id", F.col("n").alias("n_shingles"), "node"), links


def rows_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, node, component (a node; null without words) for every row."""
    members, links = join(docs, n, percent)
    of_node = common.materialize(common.components(links).withColumnRenamed("id", "node"))
    rows = common.written_join(members, of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return common.materialize(rows.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component"))))


def classes_of(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the least doc_id that links reach, the row's own included."""
    rows = rows_of(docs, n, percent)
    least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    return common.written_join(rows, common.materialize(least), "component", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, with one row of each component: that of the least id (nulls last), then of the least name of its set, then of
    the least hash of the whole row. Rows without words are in no component, and stay.

    Where an id is one row's alone, it tells the row; rows of null and repeated ids are told by the names of their sets.
    """
    rows = rows_of(docs, n, percent)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("x"))
    first = common.materialize(first.select(F.col("x.id").alias("_id"), F.col("x.node").alias("_node")))
    again = common.materialize(rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")))
    alone = first.where("_id is not null").select("_id").unionByName(rows.where("component is null and id is not null").select(F.col("id").alias("_id")))
    repeated = not again.isEmpty()
    if repeated:
        alone = common.lookup_join(alone.withColumn("_row", F.lit(0)), again, "_id", "left_anti").select("_id")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long"))
    kept = keyed.join(alone, "_id", "left_semi").select(docs.columns)
    odd = keyed.where("_id is null")
    firsts = first.where("_id is null")
    if repeated:
        odd = odd.unionByName(common.lookup_join(keyed, again, "_id", "left_semi").select(odd.columns))
        firsts = firsts.unionByName(common.lookup_join(first, again, "_id", "left_semi").select(first.columns))
    elif rows.where("id is null").isEmpty():
        return kept

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Namer()
        for b in batches:
            sets = (shingles(t.as_py() or "", n, names) for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())], names=[*b.schema.names, "_node"])

    named = common.materialize(odd.mapInArrow(name, StructType([*odd.schema.fields, StructField("_node", LongType())])))
    firsts = common.materialize(firsts.withColumnRenamed("_id", "_first"))
    of_first = common.lookup_join(named.where("_node is not null"), firsts, "_node").where("_id <=> _first")
    one = of_first.groupBy("_node").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return kept.unionByName(one).unionByName(named.where("_node is null").select(docs.columns))
