"""Byte-level BPE as a bounded-lookahead streaming transducer.

A text streams through in pieces of PIECE characters. The pretokenizer's matches are final once they end LOOK characters
before the end of what is seen. Short pretokens are merged at once and remembered; a long one is fed to ``Transducer``,
which keeps a window of bytes and emits a token as soon as no later byte can change it.

How far a later byte reaches back is computed from the merge list (``lookahead``). Let two inputs share a prefix, and let
d be the position up to which their token sequences agree while the merges are applied in order of rank. Merge (A, B) can
move d only if the last token before d is A and one input has B after it; then d moves back by len(A). The token that
starts at d has, from then on, A on its left spine, so the next merge (A', B') that moves d has a higher rank and a B'
with A on its left spine. The largest sum of len(A) over such chains of merges bounds the distance for every input.

Decoding is a state machine over bytes: tokens give bytes, which an incremental UTF-8 decoder turns into text; invalid
sequences become U+FFFD, as the library does.

Cases: null text counts as empty; an empty text has no tokens; repeated rows stay; an empty table gives an empty result;
extra columns are ignored. Added tokens in a text become their ids, unless the file says otherwise.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from veilwork.llm.common import small_batches

PIECE, LOOK = 1 << 16, 3
WINDOW = 4096
SHORT, REMEMBERED = 64, 250_000  # bytes of a pretoken merged at once; pretokens in each of two generations
#: The white space of the library's regular expression engine.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pretokens(letter: str = "\\p{L}", number: str = "\\p{N}") -> regex.Pattern:
    """The byte-level pretokenizer's pattern."""
    other = f"[^{SPACE}{letter}{number}]" if letter[0] == "\\" else f"[[^{SPACE}]--{letter}--{number}]"
    return regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def newer() -> frozenset[str]:
    """Characters that the regex module takes for letters or numbers and the library, whose Unicode is older, does not."""
    from tokenizers import pre_tokenizers

    library, ours = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and ours.match(c)]
    plain = pretokens()
    return frozenset(c for c in new if len(plain.findall(f"a{c}1")) != len(library.pre_tokenize_str(f"a{c}1")))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that a later byte can reach back, over all inputs; merges in order of rank."""
    spine: dict[bytes, bytes] = {}  # a merged token's left part
    reach: dict[bytes, int] = {}  # by A: the largest sum so far of a chain that ends with a merge (A, _)
    most = 1
    for a, b in merges:
        far, part = 0, b
        while part is not None:
            far = max(far, reach.get(part, 0))
            part = spine.get(part)
        far += len(a)
        reach[a] = max(reach.get(a, 0), far)
        most = max(most, far)
        spine.setdefault(a + b, a)
    return most


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.four = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.lookahead = lookahead(merges)
        self.added = added
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.table: list[bytes] = [b""] * (max([*self.ids.values(), *added.values()]) + 1)
        for b, i in [*self.ids.items(), *((s.encode(), i) for s, i in added.items())]:
            self.table[i] = b
        self.pretokens, self.newer = pretokens(), newer()
        less = "[" + "".join(f"\\U{ord(c):08x}" for c in sorted(self.newer)) + "]"
        self.pretokens_newer = pretokens(f"[\\p{{L}}--{less}]", f"[\\p{{N}}--{less}]") if self.newer else self.pretokens
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of one pretoken: the pair of least rank is merged first, the leftmost of equals."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank, n = self.rank, len(parts)
        heap = [(r, i, p, q) for i, (p, q) in enumerate(zip(parts, parts[1:])) if (r := rank.get((p, q))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, p, q = heapq.heappop(heap)
            j = after[i]
            if parts[i] != p or j >= n or parts[j] != q or parts[i] is None:
                continue
            parts[i], parts[j] = p + q, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p is not None]

    def packed(self, tokens: Iterable[bytes]) -> bytes:
        return b"".join([self.four[t] for t in tokens])

    def pretoken(self, word: str) -> bytes:
        """Ids of a pretoken, as packed little-endian numbers; remembered if short."""
        if (out := self.old.get(word)) is None:
            data = word.encode()
            if len(data) > SHORT:
                return b"".join(self.stream([data]))
            out = self.packed(self.merged(data))
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = out
        return out

    def stream(self, pieces: Iterable[bytes]) -> Iterator[bytes]:
        t = Transducer(self)
        for p in pieces:
            for i in range(0, len(p), WINDOW):
                yield t.feed(p[i : i + WINDOW])
        yield t.end()

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids, piece by piece."""
        if self.split is None or not any(s in text for s in self.added):
            yield from self.ordinary(text)
            return
        at = 0
        for m in self.split.finditer(text):
            yield from self.ordinary(text[at : m.start()])
            yield self.added[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self.ordinary(text[at:])

    def ordinary(self, text: str) -> Iterator[bytes]:
        at, size, pretoken = 0, len(text), self.pretoken
        pattern = self.pretokens if text.isascii() or self.newer.isdisjoint(text) else self.pretokens_newer
        while at < size:
            found = pattern.findall(text, at, min(size, at + PIECE))
            if at + PIECE < size:
                seen, tail = min(size, at + PIECE), 0
                while found and tail < LOOK:  # what ends so near the end of the piece is not final
                    tail += len(found.pop())
                if not found:  # one pretoken longer than the piece
                    end = pattern.match(text, at).end()
                    yield from self.stream(text[i : min(i + PIECE, end)].encode() for i in range(at, end, PIECE))
                    at = end
                    continue
                at = seen - tail
            else:
                at = size
            known = self.young.get
            yield b"".join([known(w) or pretoken(w) for w in found])

    def decode(self, packed: Iterable[bytes]) -> Iterator[str]:
        """Text, piece by piece."""
        state, table = codecs.getincrementaldecoder("utf-8")("replace"), self.table
        for p in packed:
            yield state.decode(b"".join([table[i] for i in np.frombuffer(p, dtype="<u4").tolist()]))
        yield state.decode(b"", True)


class Transducer:
    """Tokens of one pretoken whose bytes come in pieces. It holds the bytes that are not final: at most the lookahead,
    a token and a piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.held = vocabulary, b""

    def feed(self, data: bytes) -> bytes:
        self.held += data
        final, out, end = len(self.held) - self.v.lookahead, [], 0
        if final > 0:
            for t in self.v.merged(self.held):
                if end + len(t) > final:
                    break
                out.append(t)
                end += len(t)
            self.held = self.held[end:]
        return self.v.packed(out)

    def end(self) -> bytes:
        out, self.held = self.v.packed(self.v.merged(self.held)), b""
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    return Vocabulary(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.frombuffer(b"".join(v.encode(t or "")), dtype="<u4").astype("int32") for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, docs.select("doc_id").schema.simpleString()[7:-1] + ", ids array<int>")


def detokenized(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every array of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": ["".join(v.decode([np.asarray(i if i is not None else [], dtype="<u4").tobytes()])) for i in b["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(run, tokens.select("doc_id").schema.simpleString()[7:-1] + ", text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded and, piece by piece, decoded again."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        v = vocabulary(path)
        for b in batches:
            out = []
            for text in b.column("text"):
                ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0

                def pieces(text=text.as_py() or "", ids=ids):
                    nonlocal n
                    for p in v.encode(text):
                        ids.update(p)
                        n += len(p) // 4
                        yield p

                for t in v.decode(pieces()):
                    decoded.update(t.encode())
                out.append((n, ids.hexdigest(), decoded.hexdigest()))
            n, i, d = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
