"""The vault: stand-ins for values, kept by client and host.

A stand-in is a function of (key, client, host, kind, value), so any task, retry or partitioning gives the same, and the
vault table is only needed to restore. Use a secret key: an unkeyed hash of a phone number can be undone by counting.
"""

from __future__ import annotations

import hmac
import json
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from veilwork.operators import jsontext, ranks
from veilwork.session import settled

PAIRS, CLIENTS, TTL = 4096, 512, "48 hours"
SHARE = 1 << 16  # texts of a vault that one map serves


def digest(key: str, *parts: Column) -> Column:
    """A plain keyed digest, for use where key is no secret (tests, oracles)."""
    return F.md5(F.concat_ws("|", F.lit(key), *parts).cast("binary"))


def standin(kind: Column, digest_hex: Column) -> Column:
    """A value of the kind's shape from 32 hexadecimal digits."""
    number = lambda a, n, m: F.lpad((F.conv(F.substring(digest_hex, a, 6), 16, 10).cast("bigint") % m).cast("string"), n, "0")
    return (
        F.when(kind == "EMAIL_ADDRESS", F.concat(F.lit("user."), F.left(digest_hex, F.lit(8)), F.lit("@example.org")))
        .when(kind == "IP_ADDRESS", F.concat(F.lit("10."), (F.conv(F.substring(digest_hex, 1, 2), 16, 10)), F.lit("."), F.conv(F.substring(digest_hex, 3, 2), 16, 10), F.lit("."), F.conv(F.substring(digest_hex, 5, 2), 16, 10)))
        .when(kind == "PHONE_NUMBER", F.concat(F.lit("+1 (555) "), number(1, 3, 1000), F.lit("-"), number(7, 4, 10000)))
        .when(kind == "CREDIT_CARD_NUMBER", F.concat(F.lit("4"), number(1, 7, 10**7), number(7, 7, 10**7)))
        .otherwise(F.concat(F.lit("<"), kind, F.lit(":"), F.left(digest_hex, F.lit(8)), F.lit(">")))
    )


def secret_digest(key: bytes):
    """HMAC-SHA-256 as a pandas UDF over the joined parts, for production keys."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else hmac.new(key, p.encode(), sha256).hexdigest()[:32])

    return run


def collisions(pairs: DataFrame) -> DataFrame:
    """client, host, standin that stand for several values."""
    return pairs.groupBy("client", "host", "standin").agg(F.countDistinct("kind", "value").alias("n_values")).where("n_values > 1")


def resolved(pairs: DataFrame) -> DataFrame:
    """pairs whose stand-ins are unique within client and host: of equal ones, all but the first get their number."""
    w = Window.partitionBy("client", "host", "standin").orderBy("kind", "value")
    n = F.row_number().over(w)
    return pairs.withColumn("standin", F.when(n > 1, F.concat("standin", F.lit("~"), n.cast("string"))).otherwise(F.col("standin")))


def capped(pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """pairs and restorable: whether the pair is among the first of its client and host; new ones are refused."""
    w = Window.partitionBy("client", "host").orderBy("first_seen", "kind", "value")
    return pairs.withColumn("restorable", F.row_number().over(w) <= most)


def least_recent(clients: DataFrame, most: int = CLIENTS) -> DataFrame:
    """The clients used last: a top-k, so tasks send no more than ``most`` rows each."""
    return clients.orderBy(F.desc("last_used"), "client").limit(most)


def sessions(accesses: DataFrame, ttl: str = TTL) -> DataFrame:
    """Lives of each vault: accesses no further apart than the time to live."""
    return accesses.groupBy("client", F.session_window("at", ttl).alias("w")).agg(F.count("*").alias("n_accesses"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("w")


def known(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """tokens (client, host, kind, value, ...) and standin, if the vault (pairs) has one: a lookup in the map of its client and host."""
    return tokens.join(pairs.select("client", "host", "kind", "value", "standin"), ["client", "host", "kind", "value"], "left")


def restorable(pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """pairs (client, host, kind, value, standin, first_seen) that a restore may use: within the cap, no stand-in for two values."""
    return resolved(capped(pairs, most).where("restorable").drop("restorable"))


def spelled(pairs: dict[str, str], as_json: bool) -> dict[str, str]:
    """What to look for and what to write instead: in JSON both spellings of each stand-in, each with the value spelled alike."""
    if not as_json:
        return pairs
    return {jsontext.escaped(s, a): jsontext.escaped(v, a) for a in (True, False) for s, v in pairs.items()}


def restorer(pairs: dict[str, str]) -> re.Pattern:
    """Finds stand-ins, the longest at each place first."""
    return re.compile("|".join(re.escape(x) for x in sorted(pairs, key=lambda x: (-len(x), x))))


def replacer(written: dict[str, str]) -> Callable[[str], tuple[str, int]]:
    """As ``restorer`` with its replacements, of any number of pairs: a place is looked up by its first characters, then by the lengths of
    the stand-ins that begin so, the longest first. An expression of alternatives would try all of them at each place."""
    least = min(map(len, written), default=0)
    starts: dict[str, list[int]] = {}
    for head, size in {(x[:least], len(x)) for x in written}:
        starts.setdefault(head, []).append(size)
    for sizes in starts.values():
        sizes.sort(reverse=True)

    def run(text: str) -> tuple[str, int]:
        out, at, n, i, end = [], 0, 0, 0, len(text) - least if written else -1
        while i <= end:
            for size in starts.get(text[i : i + least], ()):
                held = text[i : i + size]
                if held in written:
                    out += (text[at:i], written[held])
                    i = at = i + len(held)
                    n += 1
                    break
            else:
                i += 1
        return "".join((*out, text[at:])), n

    return run


#: Pairs of a vault that come whole to its texts at most.
HELD = 1 << 16


def restore(texts: DataFrame, pairs: DataFrame, text: str = "text", syntax: str | None = None) -> DataFrame:
    """texts (client, host) with stand-ins put back, the longest at each place first, and n_restored. Where the column syntax is
    Json, stand-ins are looked for in both spellings of JSON writers, and values written in the one that was found.

    Vaults of at most HELD pairs come whole to their texts (``beside``). Where one is larger, texts look up what may be a stand-in
    (``looked_up``), so no task holds a vault. A pair may be given several times; of pairs that share a stand-in all the same, the least value
    is written. Texts without a map, of a null client or host, and null texts stay.
    """
    pairs = pairs.where("client is not null and host is not null and standin != ''").select("client", "host", "standin", "value")
    counts = settled(pairs.groupBy("client", "host", shape(F.col("standin")).alias("shape"), F.col("standin").rlike(jsontext.ODD).alias("odd")).agg(F.count("*").alias("n")))
    if counts.groupBy("client", "host").agg(F.sum("n").alias("n")).where(F.col("n") > HELD).isEmpty():
        return beside(texts, pairs, text, syntax)
    found = counts.select("shape").distinct()
    if syntax is not None and not counts.where("odd").isEmpty():  # shapes of the stand-ins that JSON spells in another way
        other = pairs.where(F.col("standin").rlike(jsontext.ODD)).select(F.explode(F.array(*[shape(jsontext.escape(F.col("standin"), a)) for a in (False, True)])).alias("shape"))
        found = found.unionByName(other).distinct()
    return looked_up(texts, pairs, [tuple(r[0]) for r in found.collect()], text, syntax)


def beside(texts: DataFrame, pairs: DataFrame, text: str, syntax: str | None) -> DataFrame:
    """``restore`` by whole vaults. Texts and pairs of a client and host come to one task, sorted, the pairs first, a row each: they are sent
    once, not with each text, and those of one vault are held at a time. A vault with more than SHARE texts is several shares, each with
    its pairs, so none is one task."""
    known = pairs.groupBy("client", "host", "standin").agg(F.min("value").alias("_value"))
    shares = settled(texts.groupBy("client", "host").count().where(F.col("count") > SHARE).select("client", "host", F.ceil(F.col("count") / SHARE).cast("int").alias("_shares")))
    rows = ranks.with_small(parts_of(texts, text, syntax), shares, ["client", "host"], "left").withColumn("_share", F.pmod(F.xxhash64("_text"), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    dealt = ranks.with_small(known.withColumnRenamed("standin", "_standin"), shares, ["client", "host"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    both = rows.unionByName(dealt, allowMissingColumns=True).repartition("client", "host", "_share").sortWithinPartitions("client", "host", "_share", F.col("_standin").isNull())
    return put_back(both, texts, text, ("client", "host", "_share"), replacer)


#: Letters and digits that a shape does not tell apart, and how much of a stand-in it tells.
LIKE = {**dict.fromkeys("123456789abcdefghijklmnopqrstuvwxyz", "0"), **dict.fromkeys("BCDEFGHIJKLMNOPQRSTUVWXYZ", "A")}
HEAD = 16


def shape(standin: Column) -> Column:
    """A stand-in's length, and how it begins: of a kind's stand-ins, which differ in letters and digits, there are few."""
    return F.struct(F.length(standin).alias("size"), F.translate(F.left(standin, F.lit(HEAD)), "".join(LIKE), "".join(LIKE.values())).alias("head"))


def finder(shapes: list[tuple[int, str]]) -> Callable[[str], set[str]]:
    """All parts of a text that have one of the shapes: its stand-ins are among them. Texts are searched as bytes, one a character, in
    which those beyond Latin-1 are not told apart."""
    like, least = bytes.maketrans("".join(LIKE).encode(), "".join(LIKE.values()).encode()), min((len(head) for _, head in shapes), default=0)
    starts: dict[bytes, set[tuple[int, bytes]]] = {}
    for size, head in shapes:
        head = head.encode("latin-1", "replace").translate(like)
        starts.setdefault(head[:least], set()).add((size, head))

    def run(text: str) -> set[str]:
        alike, out, n = text.encode("latin-1", "replace").translate(like), set(), len(text)
        for start, longer in starts.items():
            i = alike.find(start)
            while i >= 0:
                for size, head in longer:
                    if i + size <= n and alike.startswith(head, i):
                        out.add(text[i : i + size])
                i = alike.find(start, i + 1)
        return out

    return run


def meant(part: str) -> list[str]:
    """The stand-ins that a part of a JSON text may spell."""
    try:
        return [part, jsontext.whole(json.loads(f'"{part}"'))] if "\\" in part else [part]
    except ValueError:
        return [part]


def looked_up(texts: DataFrame, pairs: DataFrame, shapes: list[tuple[int, str]], text: str, syntax: str | None) -> DataFrame:
    """``restore`` for vaults of any size: what has the shape of a stand-in joins the pairs, by a hash of client, host and stand-in, and the
    pairs found come to their text, by a hash of the text. The text decides which of them it holds, so hashes that meet change nothing."""
    rows = parts_of(texts, text, syntax).withColumn("_key", F.xxhash64("client", "host", "_text"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shapes)
        for b in batches:
            out = []
            for s, as_json in zip(b.column("_text").to_pylist(), b.column("_json").to_pylist(), strict=True):
                found = find(s)
                out.append(list({y for x in found for y in meant(x)} if as_json and "\\" in s else found))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("_key", "client", "host")] + [pa.array(out, pa.list_(pa.string()))], names=["_key", "client", "host", "parts"])

    sought = rows.where("client is not null and host is not null and _text is not null").select("_key", "client", "host", "_text", "_json").mapInArrow(parts, "_key long, client string, host string, parts array<string>")
    sought = sought.select("_key", "client", "host", F.explode("parts").alias("part")).select("_key", F.xxhash64("client", "host", "part").alias("_pair"))
    # one shuffle for the sum and the join
    known = pairs.select(F.xxhash64("client", "host", "standin").alias("_pair"), F.col("standin").alias("_standin"), "value").repartition("_pair").groupBy("_pair", "_standin").agg(F.min("value").alias("_value"))
    hits = sought.join(known, "_pair").select("_key", "_standin", "_value")
    both = rows.drop("client", "host").unionByName(hits, allowMissingColumns=True).repartition("_key").sortWithinPartitions("_key", F.col("_standin").isNull())
    return put_back(both, texts, text, ("_key",), replaced)


def parts_of(texts: DataFrame, text: str, syntax: str | None) -> DataFrame:
    """row (the other columns), client, host, _text, and _json: whether it is one."""
    is_json = F.lit(False) if syntax is None else F.coalesce(F.col(syntax) == "Json", F.lit(False))
    return texts.select(F.struct(*[c for c in texts.columns if c != text], F.lit(0).alias("_")).alias("row"), "client", "host", F.col(text).alias("_text"), is_json.alias("_json"))


def replaced(written: dict[str, str]) -> Callable[[str], tuple[str, int]]:
    """As ``replacer``, for few texts and the stand-ins that they hold: each is searched by itself."""

    def run(text: str) -> tuple[str, int]:
        at, out, end, n = [], [], 0, 0
        for x in written:
            i = text.find(x)
            while i >= 0:
                at.append((i, -len(x), x))
                i = text.find(x, i + 1)
        for i, _, x in sorted(at):
            if i >= end:
                out += (text[end:i], written[x])
                end, n = i + len(x), n + 1
        return "".join((*out, text[end:])), n

    return run


def put_back(both: DataFrame, texts: DataFrame, text: str, by: tuple[str, ...], writer: Callable) -> DataFrame:
    """texts with the pairs that stand before them among the rows of both, sorted, of the same ``by``."""
    others = [f for f in texts.schema.fields if f.name != text]
    schema = StructType([StructField("row", StructType([*others, StructField("_", IntegerType())])), StructField("text", StringType()), StructField("n", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vault_, found, built = None, {}, {}
        for b in batches:
            kept, out = [], []
            for i, (s, as_json, standin_, value, *of) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_json", "_standin", "_value", *by)), strict=True)):
                if standin_ is not None:
                    if vault_ != of:
                        vault_, found, built = of, {}, {}
                    found[standin_] = value
                    continue
                kept.append(i)
                if s is None or vault_ != of:
                    out.append((s, 0))
                    continue
                if as_json not in built:
                    built[as_json] = writer(spelled(found, as_json))
                out.append(built[as_json](s))
            names, counts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(kept, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int32())], names=["row", "text", "n"])

    done = both.mapInArrow(run, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in texts.columns], F.col("n").alias("n_restored"))
