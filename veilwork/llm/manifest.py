"""Merkle dataset manifest: a tree of digests over every row, and a proof for each.

A row's leaf is H (lowercase hexadecimal SHA-256) of doc_id, source, lang, n_chars and text. A source's leaves, ascending by doc_id,
are the lowest level of its tree; each 16 consecutive nodes become their H, until one is left, the subroot. The subroots, in
the order of their sources, are the leaves of one more tree, whose top is the root.

``tree`` builds all trees of a table at once, as combineByKey would, driven by events. Leaves are ranked by a range shuffle, so a
source of a third of all rows is many ranges. A leaf is an event: it goes to its partial parent, keyed by (tree, level, position).
The number of children that a parent waits for follows from the tree's size, so a parent that has them all is known as such at
once: it is emitted, and is itself an event for the parent above. What a task leaves unresolved, the parents whose children
lie in two ranges, is a few nodes a range; this frontier is shuffled by key, combined, and resolved likewise, until none is left.

``paths`` follows the links from parents back to children, from the top down: the path of a node is its siblings and its parent's
path. Siblings are kept to the left and to the right apart, so that a proof can be folded again from any leaf.

Cases: null values have a mark of their own in the leaf ("-"), so null and empty texts differ; null doc_ids come before all
others, equal doc_ids in the order of their leaves; repeated rows are leaves each; a null source is a source, the first; a source of
one row is its own subroot, and a lone source's subroot is the root; long texts are hashed whole; an empty table gives an empty
result; a row without a doc_id is never tampered with; extra columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.llm import common

ARITY = 16
CHILD = "struct<i: int, digest: string, doc_id: long, other: string>"
NODE = f"tree string, size long, level int, pos long, digest string, children array<{CHILD}>"
ROWS = 4096  # of a batch that the combiner sends
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: str | Column) -> Column:
    """A value as it goes into a leaf: its bytes' count, a colon and the value; "-" if null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: str | Column = "text") -> Column:
    return F.sha2(F.concat(*[field(c) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tampered(doc_id: str = "doc_id") -> Column:
    """Whether the row is one of the fifth that the query tampers with."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, digest, ...) and size (of the tree), at (the leaf's position in it, by order, from 0).

    Ranges of (tree, order) are numbered within; the number of rows of the ranges before, a row for each range and tree, does the rest.
    """
    keys = ["tree", *order]
    numbered = common.materialize(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_range", F.shiftright("_n", 33))
    parts = numbered.groupBy("tree", "_range").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before, all_ = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    parts = parts.select("tree", "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(all_).alias("size"))
    placed = common.written_join(numbered, common.materialize(parts), ["tree", "_range"])
    return placed.withColumn("at", F.col("_n") + F.col("_shift")).drop("_n", "_range", "_shift")


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are partial nodes (of NODE, digest null); gives the nodes that these complete, with a digest, and the partial ones left."""
    schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.struct([("i", pa.int32()), ("digest", pa.string()), ("doc_id", pa.int64()), ("other", pa.string())])))])
    out: list[dict] = []
    partial: dict[tuple, list[dict]] = {}

    def resolve(tree: str, size: int, level: int, pos: int, children: list[dict]) -> None:
        while True:
            known = partial.pop((tree, level, pos), [])
            known += children
            below = -(-size // ARITY ** (level - 1))  # nodes of the level below
            if len(known) < min(ARITY, below - pos * ARITY):
                partial[tree, level, pos] = known
                sizes[tree] = size
                return
            known.sort(key=lambda c: c["i"])
            digest = known[0]["digest"] if size == 1 else sha256("".join(c["digest"] for c in known).encode()).hexdigest()
            out.append({"tree": tree, "size": size, "level": level, "pos": pos, "digest": digest, "children": known})
            if below <= ARITY:
                return
            pos, i = divmod(pos, ARITY)
            level, children = level + 1, [{"i": i, "digest": digest, "doc_id": None, "other": None}]

    sizes: dict[str, int] = {}
    for b in batches:
        for row in b.to_pylist():
            resolve(row["tree"], row["size"], row["level"], row["pos"], row["children"])
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    out += [{"tree": t, "size": sizes[t], "level": level, "pos": pos, "digest": None, "children": c} for (t, level, pos), c in partial.items()]
    for i in range(0, len(out), ROWS):
        yield pa.RecordBatch.from_pylist(out[i : i + ROWS], schema)


def tree(leaves: DataFrame) -> DataFrame:
    """leaves: tree, size, at, digest, doc_id, other. Gives every inner node: tree, size, level (from 1), pos, digest, children.
    A tree of a single leaf has one node, of the leaf's digest."""
    child = F.struct((F.col("at") % ARITY).cast("int").alias("i"), "digest", "doc_id", "other")
    events = leaves.select("tree", "size", F.lit(1).alias("level"), F.floor(F.col("at") / ARITY).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.array(child).alias("children"))
    done = None
    while True:
        found = common.materialize(events.mapInArrow(combine, NODE))
        nodes = found.where("digest is not null")
        done = nodes if done is None else done.unionByName(nodes)
        frontier = found.where("digest is null")
        if frontier.isEmpty():
            return done
        events = frontier.repartition("tree", "level", "pos")


def siblings() -> list[Column]:
    """Of a child c of a node: the digests before it and after it, each as one text."""
    digests = F.transform("children", lambda c: c["digest"])
    return [F.array_join(F.slice(digests, 1, F.col("i")), "").alias("left"), F.array_join(F.slice(digests, F.col("i") + 2, F.lit(ARITY)), "").alias("right")]


def paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Lowest nodes of each tree (level 1), with path: array of (left, right) from the node's own siblings up to the top, and on
    by the path that tops (tree, path, and further columns that are kept) has for the tree."""
    highest = nodes.agg(F.max("level")).first()[0] or 1
    kept = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in range(highest, 0, -1):
        here = nodes.where(F.col("level") == level).withColumns({"up": F.floor(F.col("pos") / ARITY).cast("long"), "i": (F.col("pos") % ARITY).cast("int")})
        top = F.col("size") <= F.lit(ARITY**level)
        rows = here.where(top).join(tops, "tree").select("tree", "size", "level", "pos", "children", "path", *kept)
        if above is not None:
            links = above.select("tree", F.col("pos").alias("up"), F.col("children").alias("family"), F.col("path").alias("onward"), *kept)
            under = here.where(~top).join(links, ["tree", "up"])
            own = F.struct(*siblings())
            under = under.withColumnRenamed("children", "_own").withColumnRenamed("family", "children").select("tree", "size", "level", "pos", F.col("_own"), F.concat(F.array(own), "onward").alias("path"), *kept)
            rows = rows.unionByName(under.withColumnRenamed("_own", "children"))
        above = rows if level == 1 else common.materialize(rows)
    return above


def proofs(lowest: DataFrame) -> DataFrame:
    """A row for each leaf of the nodes: its digest, doc_id, other, and path with the siblings of its own run first."""
    rows = lowest.select("*", F.explode("children").alias("child")).withColumn("i", F.col("child.i"))
    own = F.when(F.col("size") > 1, F.array(F.struct(*siblings()))).otherwise(F.slice("path", 1, 0))
    return rows.withColumn("_whole", F.concat(own, "path")).drop("path", "children", "i").withColumnRenamed("_whole", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that the digest start and the siblings of path lead to."""
    return F.aggregate(path, start, lambda digest, level: F.sha2(F.concat(level["left"], digest, level["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, other (the tampered row's leaf, null where the row is not tampered with), subroot, root, path of every row of docs."""
    order = F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit(""))  # null before the empty source
    changed = F.when(tampered(), leaf(F.translate("text", UPPER, LOWER)))
    leaves = docs.select(order.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), changed.alias("other"), F.monotonically_increasing_id().alias("row"))
    nodes = tree(ranked(common.materialize(leaves), ["doc_id", "digest", "row"]).drop("row"))
    # what one more tree over the subroots adds: its leaves are named by their source
    subroots = nodes.where(F.col("size") <= F.lit(float(ARITY)) ** F.col("level")).select(F.lit("").alias("tree"), "digest", F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("other"))
    over = tree(ranked(subroots, ["other"]))
    roots = over.where(F.col("size") <= F.lit(float(ARITY)) ** F.col("level")).select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    sources = proofs(paths(over, roots)).select(F.col("child.other").alias("tree"), F.col("child.digest").alias("subroot"), "root", "path")
    rows = proofs(paths(nodes, common.materialize(sources)))
    return rows.select(F.col("child.doc_id").alias("doc_id"), F.col("child.digest").alias("leaf"), F.col("child.other").alias("other"), "subroot", "root", "path")


def verified(rows: DataFrame) -> DataFrame:
    """Of manifest's rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.array_join(F.transform("path", lambda level: F.concat(level["left"], level["right"])), "")
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
