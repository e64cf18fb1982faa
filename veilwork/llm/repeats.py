"""Suffix-array dedup: repeated byte strings, by distributed prefix doubling over synchronised positions.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Doubling
over every byte position would sort one row a byte in every round, so the rounds run over the positions that two equal
strings have in common: in each window of ``length`` bytes, the GRAM-byte string with the least hash (the leftmost of
equals). Equal windows have it at the same place. The windows that share such a position are a run, which is a string of
up to 2 * length bytes.

1. Rank at GRAM bytes. Spark sorts (gram, run, id); positions whose gram occurs in one document, or in one run only, are
   unique and go. Of equal runs, all but the one of the least id are repeated as a whole and done.
2. Rank at ``doubled`` bytes, of what is left. Each window has GRAM + k bytes from the position on, or the k before it and
   the GRAM there, so each run has a pair of ranks for its windows of either kind: (rank of the gram, rank of the longer
   string). Spark sorts by the pairs; pairs of one document are unique and go.
3. Rank at ``length`` bytes: the windows of a pair that is left, each by its own bytes. A window is repeated if an equal
   one has a smaller id.

Ranks only serve to tell equal strings, so a rank is a name (a hash) and needs no count of the ranks below it; what decides
a removal has two names of 64 bits, of different strings or of different hashes. All rows are flat: one for each run, whatever the
number of tasks. A task's text is combined first: a gram or pair that is frequent in it is known to be in several
documents, so only a sign goes to the gram's task, and its runs are dealt by themselves; pairs with a sign, or with more than
HELD runs, have their windows ranked by a Spark aggregate, less those that the task's own text shows to be repeated. So no
task or group holds a frequent string's rows.

Cases: null text counts as empty; texts shorter than ``length`` keep all bytes; documents with equal ids never remove from
each other; null ids count as larger than all others, and not as smaller than each other; an empty table gives an empty
result; very long texts are worked on whole, one after another; extra columns, of any name, are ignored or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from veilwork.llm import common

LENGTH, GRAM = 50, 16
CHUNK, COMBINED = 1 << 17, 1 << 22  # bytes of text worked on at once, and whose rows are combined
HELD = 1 << 16  # runs of a pair that a task holds at once
FREQUENT = 16  # runs of a pair in COMBINED bytes from which it goes by its windows
LAST = np.iinfo("int64").max  # stands for a null id
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S32, S29 = np.uint64(32), np.uint64(29)


def doubled(length: int) -> int:
    """The longest string, with the gram at its begin or at its end, of which each window has one."""
    return (length + GRAM + 1) // 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S32)) * A
    x = (x ^ (x >> S29)) * B
    return x ^ (x >> S32)


def words_at(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The eight bytes from each position (or those at given positions) as a number; data has eight spare bytes."""
    every = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
    return every if at is None else every[at]


def named(data: np.ndarray, at: np.ndarray, length: int, seed: np.uint64 = C) -> np.ndarray:
    """Names of the strings of ``length`` bytes at the positions."""
    out = np.full(len(at), length, "u8") * seed
    for i in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out = mixed(out * A + words_at(data, at + i))
    return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows: which are the first of their keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """data: the bytes of texts one after another (and spare bytes). For each run of windows: first window, number of
    windows less one, name of the gram at the shared position, name of the run, index of the text, the position."""
    total = int(size.sum())
    wide = length - GRAM + 1  # grams in a window
    none = np.zeros(0, "i8")
    nothing = none, none, none.astype("u8"), none.astype("u8"), none, none
    if total < length:
        return nothing
    raw = words_at(data)
    h = mixed(raw[: total - GRAM + 1] * C + mixed(raw[8 : total - GRAM + 9] + B))
    low = (h >> S32 << S32) | np.arange(len(h), dtype="u8")
    step = 1
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if wide > step:
        low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
    place = (low & np.uint64(0xFFFFFFFF)).astype("i8")  # of the shared gram, by window
    text = np.repeat(np.arange(len(size)), size)[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + length <= (begin + size)[text])
    if not len(at):
        return nothing
    first = np.flatnonzero(starts(place[at], text[at]))
    p, q = at[first], at[np.r_[first[1:] - 1, len(at) - 1]]
    run = mixed(named(data, p, length) * A + named(data, q, length) * B + ((q - p) * 4096 + (place[p] - p)).astype("u8"))
    return p, q - p, h[place[p]], run, text[p], place[p]


def values(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array, and the offsets of its rows in them; nulls are empty."""
    if not len(a):
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    offsets = np.frombuffer(a.buffers()[1], "i4")[a.offset : a.offset + len(a) + 1].astype("i8")
    held = a.buffers()[2]
    return np.frombuffer(held, "u1")[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, "u1"), offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch, int]]:
    """data, begin, size, ids of texts of about CHUNK bytes together, and the batch and the row they start at."""
    for b in batches:
        ids = b.column("id").to_numpy()
        held, offsets = values(b.column("text"))
        row = 0
        while row < b.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            data = np.zeros(int(offsets[end] - offsets[row]) + 72, "u1")
            data[:-72] = held[offsets[row] : offsets[end]]
            yield data, offsets[row:end] - offsets[row], np.diff(offsets[row : end + 1]), ids[row:end], b, row
            row = end


def table(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    whole = lambda c: c.view("i8") if isinstance(c, np.ndarray) and c.dtype == "u8" else c
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(whole(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def packed(rows: np.ndarray) -> pa.Array:
    """Equally long rows of bytes as a binary array."""
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def names_as(names: np.ndarray) -> pa.Array:
    return packed(names.view("u1").reshape(-1, 8))


def combined(batches: Iterator[pa.RecordBatch], of_chunk) -> Iterator[list[np.ndarray]]:
    """The columns that of_chunk gives for each chunk, one after another, for COMBINED bytes of text at a time."""
    held, seen = [], 0
    for data, *more in chunks(batches):
        held.append(of_chunk(data, *more))
        seen += len(data)
        if seen >= COMBINED:
            yield [np.concatenate(x) for x in zip(*held)]
            held, seen = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


PLAIN, KNOWN, PASSED = 0, 1, 2
RUN = "key long, run long, id long, kind int, names binary"
MARK = "open boolean, id long, names binary, masks binary"


def ranked_runs(texts: DataFrame, length: int) -> DataFrame:
    """Round 1: MARK rows: runs that are done (names, no masks), and those that stay open."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_chunk(data, begin, size, ids, _, __):
            _, _, gram, run, text, _ = runs(data, begin, size, length)
            return gram, run, ids[text]

        for gram, run, own in combined(batches, of_chunk):
            order = np.lexsort((own, run, gram))
            gram, run, own = gram[order], run[order], own[order]
            if not len(own):
                continue
            new, first = starts(gram), starts(gram, run)
            done = own > own[first][np.cumsum(first) - 1]
            # known repeated: a row for each document
            d_id, d_run = own[done], run[done]
            by = np.argsort(d_id, kind="stable")
            d_id, d_run = d_id[by], d_run[by]
            cut = np.flatnonzero(starts(d_id))
            held = d_run.tobytes()
            names = [held[8 * i : 8 * j] for i, j in zip(cut, [*cut[1:], len(d_id)])]
            zero = np.zeros(len(cut), "i8")
            yield table(RUN, mixed(d_id[cut].astype("u8")), zero, d_id[cut], zero + PASSED, pa.array(names, pa.binary()))
            # the first of each distinct run; in grams of several runs and documents, all but the first are dealt by themselves
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            several = (np.add.reduceat(first.astype("i8"), at) > 1) & (np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at))
            known = several[group][first]
            key = np.where(known & ~new[first], mixed(gram[first] * A + run[first]), gram[first])
            yield table(RUN, key, run[first], own[first], known.astype("i4"), pa.nulls(len(key), pa.binary()))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, run and id. Of the last key, first rows of its runs wait until it is known to be of several documents; when it is, only its last run's stays, as sent."""
        none = np.zeros(0, "i8")
        carry, sent, known_key = (none, none, none, none), np.zeros(0, bool), None
        for b in chain(batches, [None]):
            rows = carry
            if b is not None:
                if passed := b.filter(pc.equal(b.column("kind"), PASSED)):
                    yield table(MARK, pa.array(np.zeros(len(passed), bool)), passed.column("id"), passed.column("names"), pa.nulls(len(passed), pa.binary()))
                b = b.filter(pc.not_equal(b.column("kind"), PASSED))
                rows = [np.r_[x, b.column(c).to_numpy()] for x, c in zip(carry, ("key", "run", "id", "kind"))]
            key, run, own, kind = rows
            if not len(key):
                continue
            sent = np.r_[sent, np.zeros(len(key) - len(sent), bool)]
            new, first = starts(key), starts(key, run)
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            several = (np.minimum.reduceat(run, at) < np.maximum.reduceat(run, at)) & (np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)) | (np.maximum.reduceat(kind, at) == KNOWN)
            several[0] |= known_key is not None and key[0] == known_key
            done = own > own[first][np.cumsum(first) - 1]
            is_open = first & several[group] & ~sent
            for x, flag in ((done, False), (is_open, True)):
                if x.any():
                    yield table(MARK, pa.array(np.full(int(x.sum()), flag)), own[x], names_as(run[x]), pa.nulls(int(x.sum()), pa.binary()))
            waits = first & (group == group[-1])
            known_key = key[-1] if several[-1] else None
            if several[-1]:
                waits[: np.flatnonzero(first)[-1]] = False
            carry, sent = tuple(x[waits] for x in rows), np.full(int(waits.sum()), bool(several[-1]))

    dealt = texts.mapInArrow(send, RUN).repartition("key").sortWithinPartitions("key", "run", "id")
    return dealt.mapInArrow(rank, MARK)


SIGN, CONTEXT, WINDOW, FOUND = 0, 1, 2, 3
PAIR = "r1 long, r2 long, kind int, id long, run long, first int, data binary"


def ranked_windows(texts: DataFrame, length: int) -> DataFrame:
    """Rounds 2 and 3: MARK rows with masks (a bit for each window of a run), of the runs named in texts."""
    half, width = doubled(length), -(-(length - GRAM + 1) // 8)

    def parts(data, begin, size, ids, b, row):
        """A run's windows by the side on which they hold the longer string: first window, how many, and its pair of ranks."""
        p, more, gram, run, text, place = runs(data, begin, size, length)
        wanted = np.unique(values(b.column("names").slice(row, len(ids)).flatten())[0].copy().view("u8"))
        use = np.flatnonzero(np.isin(run, wanted))
        p, more, gram, run, text, place = (x[use] for x in (p, more, gram, run, text, place))
        after = np.maximum(p, place - (length - half)), p + more
        before = p, np.minimum(p + more, place - (length - half) - 1)
        long = named(data, place, half), named(data, np.maximum(place - (half - GRAM), 0), half) ^ A
        out = []
        for (low, high), name in zip((after, before), long):
            ok = low <= high
            out.append((gram[ok], name[ok], ids[text[ok]], run[ok], (low - p)[ok], (high - low)[ok] + 1, low[ok]))
        return [np.concatenate(x) for x in zip(*out)]

    def pieces(data: np.ndarray, low: np.ndarray, n: np.ndarray) -> list[bytes]:
        held = data.tobytes()
        return [held[i : i + k + length - 1] for i, k in zip(low.tolist(), n.tolist())]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_chunk(data, *more):
            r1, r2, own, run, first, n, low = parts(data, *more)
            return r1, r2, own, run, first, np.array([*pieces(data, low, n), None], object)[:-1]

        for r1, r2, own, run, first, data in combined(batches, of_chunk):
            order = np.lexsort((r2, r1))
            r1, r2, own, run, first, data = (x[order] for x in (r1, r2, own, run, first, data))
            if not len(own):
                continue
            new = starts(r1, r2)
            group = np.cumsum(new) - 1
            frequent = np.bincount(group) > FREQUENT
            often = frequent[group]
            sign = new & often
            zero = np.zeros(int(sign.sum()), "i8")
            yield table(PAIR, r1[sign], r2[sign], zero + SIGN, zero, zero, zero, pa.nulls(len(zero), pa.binary()))
            rest = ~often
            yield table(PAIR, r1[rest], r2[rest], np.full(int(rest.sum()), CONTEXT), own[rest], run[rest], first[rest], pa.array(data[rest].tolist(), pa.binary()))
            if often.any():
                yield from flat(own[often], run[often], first[often], data[often].tolist())

    def windows(first: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each window of the contexts: index of its context, index in its run, two names."""
        size = np.array([len(x) for x in data], "i8")
        held = np.frombuffer(b"".join(data) + bytes(72), "u1")
        n = size - length + 1
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.cumsum(size) - size, n) + at
        return row, first[row] + at, named(held, place, length), named(held, place, length, B)

    def masks(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        bits = np.zeros((n, 8 * width), bool)
        bits[row, at] = True
        return np.packbits(bits, axis=1, bitorder="little")

    def repeated(who, n1, n2) -> np.ndarray:
        """Which windows have an equal one of a smaller id among these."""
        order = np.lexsort((who, n2, n1))
        new = starts(n1[order], n2[order])
        least = np.empty_like(who)
        least[order] = who[order][new][np.cumsum(new) - 1]
        return who > least

    def found(own, run, row, at) -> pa.RecordBatch:
        """The rows of the contexts in row, with the windows at."""
        hit, index = np.unique(row, return_inverse=True)
        return table(PAIR, run[hit], own[hit], np.full(len(hit), FOUND), own[hit], run[hit], np.zeros(len(hit), "i8"), packed(masks(index, at, len(hit))))

    def flat(own, run, first, data) -> Iterator[pa.RecordBatch]:
        """Contexts by their windows; those that these contexts show to be repeated are done."""
        row, at, n1, n2 = windows(first, data)
        again = repeated(own[row], n1, n2)
        if again.any():
            yield found(own, run, row[again], at[again])
        row, at, n1, n2 = (x[~again] for x in (row, at, n1, n2))
        yield table(PAIR, n1, n2, np.full(len(row), WINDOW), own[row], run[row], at, pa.nulls(len(row), pa.binary()))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair, kind and id. Whole pairs are ranked in a go; a pair with a sign, or of more than HELD runs, is passed on by its windows."""
        held, apart = None, None
        columns = ("r1", "r2", "kind", "id", "run", "first")
        for b in chain(batches, [None]):
            now = held
            if b is not None:
                passed = b.filter(pc.greater_equal(b.column("kind"), WINDOW))
                if len(passed):
                    yield passed
                b = b.filter(pc.less(b.column("kind"), WINDOW))
                now = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()
                now = now[0] if now else None
            if now is None or not len(now):
                continue
            r1, r2, kind, own, run, first = (now.column(c).to_numpy() for c in columns)
            new = starts(r1, r2)
            group = np.cumsum(new) - 1
            signed = np.zeros(group[-1] + 1, bool)
            signed[group[kind == SIGN]] = True
            signed[0] |= apart == (r1[0], r2[0])
            size = np.bincount(group)
            signed |= size > HELD
            last = (r1[-1], r2[-1])
            ends = len(now) if b is None or signed[-1] else int(np.flatnonzero(new)[-1])  # rows to be done now
            held, apart = (now.slice(ends) if ends < len(now) else None), last if signed[-1] else None
            use = np.arange(len(now)) < ends
            far = np.flatnonzero(use & signed[group] & (kind == CONTEXT))
            if len(far):
                yield from flat(own[far], run[far], first[far], now.column("data").take(pa.array(far)).to_pylist())
            # a pair of one document is unique
            at = np.flatnonzero(new)
            several = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at)
            near = np.flatnonzero(use & ~signed[group] & several[group])
            if not len(near):
                continue
            row, w, n1, n2 = windows(first[near], now.column("data").take(pa.array(near)).to_pylist())
            again = repeated(own[near][row], n1, n2)
            if again.any():
                yield found(own[near], run[near], row[again], w[again])

    out = texts.mapInArrow(send, PAIR).repartition("r1", "r2").sortWithinPartitions("r1", "r2", "kind", "id").mapInArrow(resolve, PAIR)
    out = common.materialize(out)
    done = out.where(F.col("kind") == FOUND).select("id", "run", F.col("data").alias("masks"))
    single = out.where(F.col("kind") == WINDOW)
    if not single.isEmpty():
        least = single.groupBy("r1", "r2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("r1", "r2", "least")
        again = single.join(common.materialize(least), ["r1", "r2"]).where("id > least").select("id", "run", "first")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = b.column("first").to_numpy()
                yield table("id long, run long, masks binary", b.column("id"), b.column("run"), packed(masks(np.arange(len(w)), w, len(w))))

        done = done.unionByName(common.materialize(again).mapInArrow(pack, "id long, run long, masks binary"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield table(MARK, pa.array(np.zeros(len(b), bool)), b.column("id"), names_as(b.column("run").to_numpy()), b.column("masks"))

    return done.mapInArrow(name, MARK)


def handed(rows: DataFrame, found: DataFrame, twice: DataFrame | None, length: int) -> DataFrame:
    """many, key, marks: what found (id, names, masks) has for the rows (many, key, id, text). A row whose id is its own gets the marks of
    its id. One that shares its id gets those that are of its own runs, joined by id and run: else each row of an id would get the
    marks of all of them."""
    alone = found if twice is None else found.join(twice, "id", "left_anti")
    lists = alone.groupBy("id").agg(F.collect_list(F.struct("names", "masks")).alias("marks")).select(F.lit(False).alias("many"), F.col("id").alias("key"), "marks")
    if twice is None:
        return lists

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            for data, begin, size, ids, _, row in chunks([b]):
                _, _, _, run, text, _ = runs(data, begin, size, length)
                order = np.lexsort((run, text))
                order = order[starts(text[order], run[order])]
                yield table("key long, id long, names binary", keys[row + text[order]], ids[text[order]], names_as(run[order]))

    own = rows.where("many").select("key", "id", "text").mapInArrow(runs_of, "key long, id long, names binary").distinct()
    each = found.join(twice, "id", "left_semi").select("id", F.explode(F.expr("transform(sequence(0, length(names) div 8 - 1), i -> substring(names, i * 8 + 1, 8))")).alias("names"), "masks").distinct()
    many = own.join(each, ["id", "names"]).groupBy("key").agg(F.collect_set(F.struct("names", "masks")).alias("marks"))
    return lists.unionByName(many.select(F.lit(True).alias("many"), "key", "marks"))


def marks(texts: DataFrame, twice: DataFrame | None, length: int) -> DataFrame:
    """id, names, masks: which runs of a document are repeated, by name: all windows, or those of the mask."""
    found = common.materialize(ranked_runs(texts, length))
    still = handed(texts, found.where("open").select("id", "names", "masks"), twice, length).select("many", "key", F.transform("marks", lambda m: m["names"]).alias("names"))
    edges = ranked_windows(texts.join(still, ["many", "key"]), length)
    return found.where("not open").unionByName(edges).select("id", "names", "masks")


def marked(docs: DataFrame, length: int, schema, finish) -> DataFrame:
    """finish(rows of docs as a batch, their packed spans) for every batch of docs."""
    common.small_batches(docs.sparkSession)
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))), common.text_of()
    twice = common.materialize(docs.select(id_.alias("id")).groupBy("id").count().where("count > 1").select("id"))
    twice = None if twice.isEmpty() else twice
    rows = docs.select(F.struct("*").alias("doc"), id_.alias("id"), text.alias("text"))
    many = F.lit(False)
    if twice is not None:
        rows = common.written_join(rows, common.materialize(twice.withColumn("many", F.lit(True))), "id", "left")
        many = F.coalesce("many", F.lit(False))
    rows = rows.withColumn("many", many).withColumn("key", F.when(F.col("many"), F.xxhash64("id", "text")).otherwise(F.col("id")))
    texts = rows.select("many", "key", "id", "text")
    found = handed(texts, marks(texts, twice, length), twice, length)
    rows = rows.select("doc", "id", "many", "key").join(found, ["many", "key"], "left")
    width = -(-(length - GRAM + 1) // 8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pa.RecordBatch.from_struct_array(b.column("doc"))
            text = doc.column("text").fill_null("")
            of, name, mask = unpacked(b.column("marks"), width)
            spans = []
            for data, begin, size, _, _, row in chunks([pa.RecordBatch.from_arrays([text, b.column("id")], names=["text", "id"])]):
                i, j = np.searchsorted(of, [row, row + len(size)])
                spans += covered(data, begin, size, of[i:j] - row, name[i:j], mask[i:j], length)
            yield finish(doc, spans)

    return rows.select("doc", "id", "marks").mapInArrow(mark, schema)


def unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """Row, name and mask of each mark in a column of lists of (names, masks); no masks means all windows."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    names, masks = column.flatten().flatten()
    held, at = values(names)
    per = np.diff(at) // 8
    mask = np.full((int(per.sum()), width), 255, "u1")
    some, where = values(masks)
    has = np.repeat(np.diff(where) > 0, per)
    mask[has] = some.reshape(-1, width)
    return np.repeat(np.repeat(np.arange(len(column)), length), per), held.copy().view("u8"), mask


def covered(data: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray, name: np.ndarray, mask: np.ndarray, length: int) -> list[bytes]:
    """The packed spans of each text, from its marks: index of the text, name of the run, windows."""
    if not len(of):
        return [b""] * len(size)
    p, more, _, run, text, _ = runs(data, begin, size, length)
    order = np.lexsort((name, of))
    of, name, mask = of[order], name[order], mask[order]
    first = np.flatnonzero(starts(of, name))
    of, name, mask = of[first], name[first], np.bitwise_or.reduceat(mask, first, axis=0)
    # runs meet marks by text and name; a match is checked by both
    key, mine = (mixed(n * A + t.astype("u8")) for n, t in ((name, of), (run, text)))
    order = np.argsort(key)
    found = order[np.minimum(np.searchsorted(key[order], mine), len(key) - 1)]
    hit = np.flatnonzero((name[found] == run) & (of[found] == text))
    whole = (mask[found[hit]] == 255).all(1)
    done, part = hit[whole], hit[~whole]
    row, at = np.nonzero(np.unpackbits(mask[found[part]], axis=1, bitorder="little"))
    at, row = (x[at <= more[part[row]]] for x in (at, row))
    low = np.r_[p[done], p[part[row]] + at]
    high = np.r_[p[done] + more[done], p[part[row]] + at] + length
    t = np.r_[text[done], text[part[row]]]
    if not len(low):
        return [b""] * len(size)
    order = np.argsort(low, kind="stable")
    low, high, t = low[order], np.maximum.accumulate(high[order]), t[order]
    cut = np.flatnonzero((low[1:] > high[:-1]) | (t[1:] != t[:-1]))
    i, j = np.r_[0, cut + 1], np.r_[cut, len(low) - 1]
    spans = np.stack([low[i] - begin[t[i]], high[j] - begin[t[i]]], 1).astype("<i8")
    edge = np.searchsorted(t[i], np.arange(len(size) + 1))
    return [spans[a:b].tobytes() for a, b in zip(edge, edge[1:])]


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, and spans: pairs of begin and end, in bytes, of the maximal repeated runs, as packed 64-bit numbers."""
    docs = docs.drop("spans")
    finish = lambda doc, found: pa.RecordBatch.from_arrays([*doc.columns, pa.array(found, pa.binary())], names=[*doc.schema.names, "spans"])
    return marked(docs, length, StructType([*docs.schema.fields, StructField("spans", BinaryType())]), finish)


def kept(data: bytes, packed_spans: bytes) -> bytes:
    """data without the spans."""
    out, at = [], 0
    for b, e in np.frombuffer(packed_spans, "<i8").reshape(-1, 2).tolist():
        out.append(data[at:b])
        at = e
    return b"".join([*out, data[at:]])


def kept_text(text: str, packed_spans: bytes) -> str:
    """text without the characters that lie within the spans as a whole."""
    data = text.encode()
    out, at = [], 0
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    for b, e in np.frombuffer(packed_spans, "<i8").reshape(-1, 2).tolist():
        while inside(b):
            b += 1
        while e > b and inside(e):
            e -= 1
        out.append(data[at:b])
        at = max(b, e)
    return b"".join([*out, data[at:]]).decode()


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(doc: pa.RecordBatch, found: list[bytes]) -> pa.RecordBatch:
        rows = []
        for text, s in zip(doc.column("text").to_pylist(), found):
            data = (text or "").encode()
            rest = kept(data, s)
            rows.append((len(data), len(data) - len(rest), len(s) // 16, sha256(rest).hexdigest()))
        n, r, k, h = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([doc.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, r, k)], pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.select("doc_id").schema.fields
    numbers = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return marked(docs.select("doc_id", "text"), length, StructType([*kind, *numbers, StructField("kept_sha256", StringType())]), finish)


def without(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages cut from text, and n_chars, if there, set anew."""

    def finish(doc: pa.RecordBatch, found: list[bytes]) -> pa.RecordBatch:
        at = doc.schema.get_field_index("text")
        text = [t if t is None or not s else kept_text(t, s) for t, s in zip(doc.column("text").to_pylist(), found)]
        return doc.set_column(at, doc.schema.field(at), pa.array(text, pa.string()))

    out = marked(docs, length, docs.schema, finish)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
