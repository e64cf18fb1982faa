"""Many literals in many texts: one automaton that reads a text once, whatever the number of literals.

Each worker builds the automaton (a trie with failure links) of a block of literals once and runs its texts through it. A block has at
most BLOCK characters of literals, which bounds what is sent and held; more literals are several blocks, each with a pass
over the texts. Only places where a literal stands by itself count: no letter, digit or dot before it, no letter or digit after it.

Cases: null texts hold nothing; null and empty literals are nowhere; equal literals count once; literals inside of each other are all
found; offsets are code points; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from veilwork.session import settled

BLOCK = 8 << 20

_built: dict[str, ahocorasick.Automaton | None] = {}


def automaton(name: str, words: Iterable[tuple[str, Any]]) -> ahocorasick.Automaton | None:
    """The automaton of a block of words, each with what it yields, built once a worker; None of no words."""
    if name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for w, yields in words:
            a.add_word(w, yields)
        a.make_automaton()
        _built[name] = a if len(a) else None
    return _built[name]


def solid(c: str) -> bool:
    return c.isalpha() or "0" <= c <= "9"


def alone(text: str, start: int, end: int) -> bool:
    return not (start and (solid(text[start - 1]) or text[start - 1] == ".")) and not (end < len(text) and solid(text[end]))


def blocks(literals: DataFrame) -> Iterator[list[Row]]:
    """The rows of literals (literal, ...), in blocks of about BLOCK characters; those of equal literals are in one block."""
    known = literals.where("literal != ''").persist()
    n = -(-(known.agg(F.sum(F.length("literal"))).first()[0] or 0) // BLOCK)
    for i in range(n):
        yield sorted(known.where(F.pmod(F.xxhash64("literal"), F.lit(n)) == i).collect(), key=lambda r: r["literal"])
    known.unpersist()


def found(docs: DataFrame, literals: DataFrame, first_only: bool = False, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, end, literal for each place of each text (of docs: id_col, text) where a literal stands by itself; with first_only,
    one row for each text and literal."""
    rows = docs.where("text is not null").select(id_col, "text")
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, start int, end int, literal string"
    out = None
    for block in blocks(literals.select("literal").distinct()):
        name, words = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast([r["literal"] for r in block])

        def run(batches: Iterator[pa.RecordBatch], name=name, words=words) -> Iterator[pa.RecordBatch]:
            look = automaton(name, ((w, len(w)) for w in words.value))
            for b in batches:
                hits: list[tuple] = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen = set()
                    for last, size in look.iter(text) if look else ():
                        start, end = last + 1 - size, last + 1
                        if alone(text, start, end) and not (first_only and text[start:end] in seen):
                            seen.add(text[start:end])
                            hits.append((i, start, end, text[start:end]))
                kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*hits)) or [()] * 4, kinds, strict=True)], names=[id_col, "start", "end", "literal"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


#: The places of a text's literals, and what is known of each
PLACES = "array<struct<start: int, end: int, value: string, kind: string, tier: string, ordinal: int>>"


def beside(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (with a text) and ``places``: where a literal of known (literal, kind, tier, ordinal) stands by itself, a place for each row of
    known. What is known goes with the automaton, so no text or place is shuffled. Of several blocks, each pass adds its places."""
    rows = docs.withColumn("places", F.expr(f"cast(array() as {PLACES})"))
    for i, block in enumerate(b for b in blocks(known.select("literal", "kind", "tier", "ordinal")) if b):
        # passes that run into one another would hold all blocks' automatons at once
        rows = settled(rows) if i else rows
        name, held = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches: Iterator[pa.RecordBatch], name=name, held=held) -> Iterator[pa.RecordBatch]:
            said = defaultdict(list)
            for n, (literal, *_) in enumerate(held.value if name not in _built else ()):
                said[literal].append(n)
            look = automaton(name, ((w, (len(w), ns)) for w, ns in said.items()))
            # a place has the number of known's row; Arrow takes that row's values for all places of a batch
            about = [pa.array(c, k) for c, k in zip(zip(*held.value), (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)]
            for b in batches:
                starts, ends, which, upto = [], [], [], [0]
                for text in b.column("text").to_pylist():
                    for last, (size, ns) in look.iter(text) if text else ():
                        start, end = last + 1 - size, last + 1
                        if alone(text, start, end):
                            for n in ns:
                                starts.append(start)
                                ends.append(end)
                                which.append(n)
                    upto.append(len(which))
                n = pa.array(which, pa.int32())
                places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *(c.take(n) for c in about)], ["start", "end", "value", "kind", "tier", "ordinal"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), places)], names=[*b.schema.names, "more"])

        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        rows = rows.mapInArrow(run, f"{schema}, more {PLACES}").withColumn("places", F.concat("places", "more")).drop("more")
    return rows
