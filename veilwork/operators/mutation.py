"""Message bodies redacted in place, and put back: the data path of an exchange.

A body is bytes with a content type and encoding. It is decoded and searched value by value: a JSON body's values are its strings, wherever
they stand; any other text, also a JSON body that is none, is one value. A value's findings are placed in the decoded value, and
written over the raw body: an index map, one breakpoint for each escape, leads from decoded to raw offsets by binary search.
Outside of the stand-ins the body keeps every character, escapes and white space included.

``redacted`` works within the row: parsing is a step in batches, all else are expressions, so nothing is shuffled. ``redacted_apart``
shuffles what tells equal stand-ins, ``restored`` what joins texts with the vault's pairs. A request that cannot be read (encoding, charset, size) is refused: its body is null, so
nothing unredacted goes on. A response that cannot be read is left as it is.

Cases: null bodies are passed on as null, with the status none; empty bodies are clean; repeated ids are rows each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilwork.functions import detect
from veilwork.operators import jsontext, route, spans, vault
from veilwork.session import settled
from veilwork.sources import bodies

LIMIT = 1 << 20
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|.)", re.S)
VALUES = "array<struct<start: int, value: string, breaks: array<struct<decoded: int, raw: int>>>>"


def breaks(raw: str) -> list[dict[str, int]]:
    """Where decoded and raw offsets of a JSON string part: after each escape. Two escapes of a surrogate pair are one character."""
    out, more, high = [], 0, -1
    for m in ESCAPE.finditer(raw):
        unit = int(m[1], 16) if m[1] else 0
        low = 0xDC00 <= unit < 0xE000 and high == m.start()
        high = m.end() if 0xD800 <= unit < 0xDC00 else -1
        more += len(m[0]) - (0 if low else 1)
        out.append({"decoded": m.end() - more, "raw": m.end()})
    return out


def values(text: str, as_json: bool, wanted: bool = True) -> tuple[str, list[dict]]:
    """The syntax that the text has, and its values if they are wanted."""
    found = jsontext.located(text) if as_json else None
    if not wanted:
        return "Text" if found is None else "Json", []
    if found is None:
        return "Text", [{"start": 0, "value": text, "breaks": []}]
    return "Json", [{"start": s, "value": v, "breaks": breaks(text[s : s + n])} for s, n, v, _ in found]


def parsed(messages: DataFrame, limit: int = LIMIT, wanted: bool = True) -> DataFrame:
    """messages (body, content_type, content_encoding, ...) and text, syntax, values (empty if not wanted), unread (why the body cannot
    be read, or null)."""
    rows = messages.select("*", bodies.charset(F.col("content_type")).alias("_charset"), F.coalesce(route.body_syntax(F.col("content_type")) == "Json", F.lit(False)).alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, encoding, charset, as_json in zip(*[b.column(c).to_pylist() for c in ("body", "content_encoding", "_charset", "_json")], strict=True):
                row = {"text": None, "syntax": None, "values": [], "unread": None}
                try:
                    plain = bodies.undone(body, encoding, limit)
                    if body is not None and plain is None:
                        row["unread"] = "encoding or size"
                    elif body is not None:
                        row["text"] = bytes(plain).decode(charset)
                        row["syntax"], row["values"] = values(row["text"], as_json, wanted)
                except UnicodeDecodeError:
                    row["unread"] = "charset"
                out.append(row)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[n] for r in out], t) for n, t in kinds.items()]], names=[*b.schema.names, *kinds])

    kinds = {"text": pa.string(), "syntax": pa.string(), "values": pa.list_(pa.struct([("start", pa.int32()), ("value", pa.string()), ("breaks", pa.list_(pa.struct([("decoded", pa.int32()), ("raw", pa.int32())])))])), "unread": pa.string()}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, text string, syntax string, values {VALUES}, unread string").drop("_charset", "_json")


def last_break(breaks: str, at: str) -> str:
    """SQL: the number, from 1, of the last breakpoint that is not behind a decoded offset; 0 if none is."""
    middle = "(s.low + s.high + 1) div 2"
    step = f"if(s.low >= s.high, s, if(element_at({breaks}, cast({middle} as int)).decoded <= {at}, named_struct('low', cast({middle} as int), 'high', s.high), named_struct('low', s.low, 'high', cast({middle} as int) - 1)))"
    return f"if(size({breaks}) = 0, 0, aggregate(sequence(0, cast(log2(size({breaks})) as int)), named_struct('low', 0, 'high', size({breaks})), (s, i) -> {step}, s -> s.low))"


def raw_offset(breaks: str, at: str, last: str) -> str:
    """SQL: the raw offset of a decoded one, from its last breakpoint."""
    return f"if({last} = 0, {at}, {at} - element_at({breaks}, {last}).decoded + element_at({breaks}, {last}).raw)"


def kept_in_values(kinds: list[str] | None = None) -> Column:
    """array<struct<n, kept>>, one for each of the column values: how many findings it has, and array<struct<start, end (raw), kind,
    value>> of those that are replaced: sure ones, without overlaps. Values do not overlap, so each is told by itself."""
    # most findings hold no escape, so both their ends have the same last breakpoint
    end = f"transform(array(if(b < size(v.breaks) and element_at(v.breaks, b + 1).decoded <= f.end, {last_break('v.breaks', 'f.end')}, b)), e -> {raw_offset('v.breaks', 'f.end', 'e')})[0]"
    raw = f"transform(array({last_break('v.breaks', 'f.start')}), b -> named_struct('start', v.start + {raw_offset('v.breaks', 'f.start', 'b')}, 'end', v.start + {end}, 'kind', f.kind, 'value', f.value))[0]"
    sure = f"transform(array(filter(fs, f -> f.score >= {detect.THRESHOLD})), sure -> {spans.non_overlapping_sql('sure', 'start, -(end - start), kind')})[0]"
    return F.expr(f"transform(values, v -> transform(array({detect.found_sql('v.value', kinds)}), fs -> named_struct('n', size(fs), 'kept', transform({sure}, f -> {raw})))[0])")


def placed(requests: DataFrame, key: str, kinds: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """requests (client, host, body, content_type, content_encoding, ...) with status (none, refused, clean or treated), redacted (the
    body as text, null if refused), found, syntax, and places: start and end in the body's text, kind, value, standin of what was replaced."""
    rows = parsed(requests, limit).withColumn("_each", F.when(F.col("unread").isNull(), kept_in_values(kinds)))

    def written(x: Column) -> Column:
        standin = vault.standin(x["kind"], vault.digest(key, F.col("client"), F.col("host"), x["kind"], x["value"]))
        return x.withField("token", standin).withField("standin", spelled(standin))

    # an explode of one, not a column: Spark would put it into each of its uses
    rows = rows.withColumn("_put", F.explode(F.array(F.transform(F.flatten(F.transform("_each", lambda v: v["kept"])), written))))
    status = F.when(F.col("body").isNull(), "none").when(F.col("unread").isNotNull(), "refused").when(F.size("_put") > 0, "treated").otherwise("clean")
    places = F.transform("_put", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"), x["token"].alias("standin")))
    return rows.select(*requests.columns, status.alias("status"), F.when(F.size("_put") > 0, spans.splice("text", "_put")).otherwise(F.col("text")).alias("redacted"), F.coalesce(F.aggregate("_each", F.lit(0), lambda n, v: n + v["n"]), F.lit(0)).alias("found"), "syntax", places.alias("places"))


def spelled(standin: Column) -> Column:
    """A stand-in as it is written in a body of the column syntax."""
    return F.when((F.col("syntax") == "Json") & standin.rlike(jsontext.ODD), jsontext.escape(standin)).otherwise(standin)


def with_tokens(rows: DataFrame, once: bool = True) -> DataFrame:
    """rows of ``placed`` with tokens (kind, value, standin) for the places; each once, or as often as it stands there."""
    tokens = F.transform("places", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["standin"].alias("standin")))
    tokens = F.array_distinct(tokens) if once else tokens
    return rows.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<struct<kind: string, value: string, standin: string>>"))).drop("syntax", "places")


def redacted(requests: DataFrame, key: str, kinds: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """requests (client, host, body, content_type, content_encoding, ...) with status (none, refused, clean or treated), redacted (the
    body as text, null if refused), found, and tokens (kind, value, standin of what was replaced)."""
    return with_tokens(placed(requests, key, kinds, limit))


def redacted_apart(requests: DataFrame, key: str, kinds: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """As ``redacted``, and of the values of a client and host that get the same stand-in, all but the first get another: a restore
    knows which was meant. tokens has a value as often as the body. The bodies are searched once and written; those that hold such values, and no others, are written anew.

    Equal stand-ins are told by hashes, a row of two numbers for each place; what the hashes leave is told exactly.
    """
    rows = settled(placed(requests, key, kinds, limit).withColumn("_row", F.monotonically_increasing_id()))
    each = rows.where("client is not null and host is not null").select("_row", "client", "host", F.posexplode("places").alias("_i", "p")).select("_row", "_i", "client", "host", "p.kind", "p.value", "p.standin").withColumn("_key", F.xxhash64("client", "host", "standin"))
    value = F.xxhash64("kind", "value")
    twice = settled(each.groupBy("_key").agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low != high").select("_key"))
    held = settled(numbers_join(each, twice, "_key", "left_semi").drop("_key"))
    pairs = held.select("client", "host", "kind", "value", "standin").distinct()
    other = vault.resolved(pairs.withColumn("_base", F.col("standin"))).where("standin != _base").select("client", "host", "kind", "value", F.col("standin").alias("_new"))
    moved = settled(held.join(other, ["client", "host", "kind", "value"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_new"))).alias("_moved")))
    which = moved.select("_row")
    if moved.isEmpty():
        return with_tokens(rows.drop("_row"), False)
    anew = numbers_join(rows, which, "_row", "left_semi").join(moved, "_row")
    # where a place is in the redacted text: what was written before it is longer or shorter than what it stands for
    wrote = F.transform("places", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.length(spelled(p["standin"])).alias("n"), spelled(F.coalesce(F.try_element_at("_moved", i), p["standin"])).alias("standin")))
    shifted = "aggregate(_wrote, named_struct('by', 0, 'out', cast(array() as array<struct<start: int, end: int, standin: string>>)), (acc, p) -> named_struct('by', acc.by + p.n - (p.end - p.start), 'out', array_append(acc.out, named_struct('start', p.start + acc.by, 'end', p.start + acc.by + p.n, 'standin', p.standin))), acc -> acc.out)"
    anew = anew.withColumn("_wrote", wrote).withColumn("_wrote", F.expr(shifted)).withColumn("redacted", spans.splice("redacted", "_wrote"))
    anew = anew.withColumn("places", F.transform("places", lambda p, i: p.withField("standin", F.coalesce(F.try_element_at("_moved", i), p["standin"]))))
    return with_tokens(numbers_join(rows, which, "_row", "left_anti").unionByName(anew.select(rows.columns)).drop("_row"), False)


#: Numbers that are broadcast at most: about 50 MB.
NUMBERS = 1 << 20


def numbers_join(rows: DataFrame, numbers: DataFrame, key: str, how: str) -> DataFrame:
    """Join to a settled table of one column of numbers: a broadcast up to NUMBERS, else a shuffle."""
    return rows.join(F.broadcast(numbers) if numbers.count() <= NUMBERS else numbers, key, how)


def tokens_of(treated: DataFrame) -> DataFrame:
    """client, host, kind, value, standin of each treated request, a pair as often as requests have it."""
    return treated.select("client", "host", F.explode("tokens").alias("t")).select("client", "host", "t.kind", "t.value", "t.standin")


def pairs_of(treated: DataFrame) -> DataFrame:
    """client, host, kind, value, standin: what the vault keeps of the treated requests."""
    return tokens_of(treated).distinct()


def restored(responses: DataFrame, pairs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """responses (client, host, ..., without body) with status (none, kept, or restored), restored (bytes: the body in UTF-8 with its
    values put back, or, where it cannot be read, as it came) and n_restored. A pair may be given several times."""
    status = F.when(F.col("body").isNull(), "none").when(F.col("unread").isNotNull(), "kept").otherwise("restored")
    others = [c for c in responses.columns if c != "body"]
    # bodies that were read go no further than their text
    rows = parsed(responses, limit, False).select(*others, "text", "syntax", status.alias("status"), F.when(F.col("unread").isNotNull(), F.col("body")).alias("_kept"))
    rows = vault.restore(rows, pairs, "text", "syntax")
    return rows.select(*others, "status", F.coalesce("_kept", F.encode("text", "UTF-8")).alias("restored"), "n_restored")


#: Mutations by name: requests -> requests with ``redacted``. The first forwards every body as it is.
MUTATIONS = {
    "passthrough": lambda requests, key: requests.select("*", F.lit("clean").alias("status"), F.decode("body", "UTF-8").alias("redacted"), F.lit(0).alias("found"), F.array().cast("array<struct<kind: string, value: string, standin: string>>").alias("tokens")),
    "redact": redacted,
}


def mutated(requests: DataFrame, key: str, name: str = "redact") -> DataFrame:
    if name not in MUTATIONS:
        raise ValueError(f"no mutation {name!r}; there are {', '.join(sorted(MUTATIONS))}")
    return MUTATIONS[name](requests, key)


def split_at(text: str, spans_: str) -> Column:
    """array<struct<text, span>>: the text cut at sorted, disjoint spans (columns' names); span is the number of the span, or null between."""
    return F.expr(split_at_sql(text, f"transform({spans_}, s -> named_struct('start', s.start, 'end', s.end, 'value', substring({text}, s.start + 1, s.end - s.start)))"))


def split_by(text: str, needles: list[str]) -> Column:
    """array<struct<text, span>>: the text cut at the places of the needles, the earliest first, of one place the longest; span is the
    needle's number in the list, or null between."""
    found = sorted({n for n in needles if n}, key=lambda n: (-len(n), n))
    if not found:
        return F.array(F.struct(F.col(text).alias("text"), F.lit(None).cast("int").alias("span")))
    pattern = "|".join(re.escape(n) for n in found)
    places = detect.matches_sql(text, pattern)
    numbers = f"map({', '.join(f'{detect.literal(n)}, {needles.index(n)}' for n in found)})"
    named = f"transform({split_at_sql(text, places)}, p -> named_struct('text', p.text, 'span', if(p.span is null, cast(null as int), {numbers}[p.text])))"
    return F.expr(named)


def split_at_sql(text: str, places: str) -> str:
    ends = f"concat(transform(ps, p -> p.start), array(length({text})))"
    between = f"transform({ends}, (e, i) -> named_struct('at', if(i = 0, 0, element_at(ps, i).end), 'to', e))"
    piece = f"flatten(transform({between}, (g, i) -> concat(if(g.to > g.at, array(named_struct('text', substring({text}, g.at + 1, g.to - g.at), 'span', cast(null as int))), cast(array() as array<struct<text: string, span: int>>)), if(i < size(ps), array(named_struct('text', element_at(ps, i + 1).value, 'span', i)), cast(array() as array<struct<text: string, span: int>>)))))"
    return f"element_at(transform(array({places}), ps -> {piece}), 1)"
