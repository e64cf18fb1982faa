"""JSON bodies: where the string values stand, their paths, and how a value is written in one.

Offsets are code points. ``string_values`` is a table function in batches: JSON parsers of the engine drop offsets, repeated keys
and comments. Bodies may have comments and trailing commas; what is no JSON has no rows (and ``valid`` is false).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = re.compile(r'[ \t\r\n]*+(?:(?P<string>"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")|(?P<atom>(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-]))|(?P<mark>[{}\[\]:,])|//[^\r\n]*|/\*.*?\*/|\Z)', re.S)
DEEPEST = 64
#: A character that a JSON writer may spell in another way. The complement of the others takes ten times as long.
ODD = r'[\x00-\x1f"\\\x{80}-\x{10ffff}]'
#: What may come next: a value, a value or the end of the list, a key or the end of the object, and so on.
VALUE, ITEM, KEY, COLON, COMMA, END = "value", "item", "key", ":", ",", "end"


def whole(text: str) -> str:
    """text with lone surrogates replaced, as no encoding has them."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unquoted(token: str) -> str:
    """The value of a string, most of which are as they are written."""
    return token[1:-1] if token.isascii() and "\\" not in token else whole(json.loads(token))


def located(text: str) -> list[tuple[int, int, str, str]] | None:
    """Start, length, value and dotted path of each string value; lists share the path of their key. None if text is no JSON."""
    out, at, open_, keys, key, path, want = [], 0, [], [], "", None, VALUE
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            return None
        at, kind = m.end(), m.lastgroup
        if kind is None:
            continue
        token = m[kind]
        if token == ":" or token == ",":
            if want != token:
                return None
            want = VALUE if token == ":" else KEY if open_[-1] == "{" else ITEM
        elif token in ("}", "]"):
            if not open_ or open_[-1] + token not in ("{}", "[]") or want not in (COMMA, KEY, ITEM):
                return None
            if open_.pop() == "{":
                key, path = keys.pop(), None
            want = COMMA if open_ else END
        elif want == KEY:
            if kind != "string":
                return None
            key, path, want = unquoted(token), None, COLON
        elif want not in (VALUE, ITEM):
            return None
        elif kind == "mark":
            if len(open_) == DEEPEST:
                return None
            open_.append(token)
            want = ITEM
            if token == "{":
                keys.append(key)
                key, path, want = "", None, KEY
        else:
            if kind == "string":
                if path is None:
                    path = ".".join(filter(None, [*keys, key]))
                out.append((m.start(kind) + 1, len(token) - 2, unquoted(token), path))
            want = COMMA if open_ else END
    return out if want == END else None


def string_values(bodies: DataFrame, body: str = "body", id_col: str = "id") -> DataFrame:
    """id_col, ordinal, start, length (as written, escapes included), value, path of each string value of each body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, v in enumerate((t and located(t)) or ())]
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=[id_col, "ordinal", "start", "length", "value", "path"])

    return bodies.select(id_col, body).mapInArrow(run, f"{id_col} {dict(bodies.dtypes)[id_col]}, ordinal int, start int, length int, value string, path string")


def labelled(values: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col, joined: a line ``[path] value`` for each string value, in order, for one search over a whole body."""
    line = F.when(F.col("path") == "", F.col("value")).otherwise(F.concat(F.lit("["), "path", F.lit("] "), "value"))
    each = values.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    return each.select(id_col, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("joined"))


def escaped(value: str, ascii_only: bool = False) -> str:
    """value as JSON writers spell it between quotes: with other characters as they are, or all but ASCII as escapes."""
    if value.isascii() and value.isprintable() and '"' not in value and "\\" not in value:
        return value
    return json.dumps(value, ensure_ascii=ascii_only)[1:-1].replace("\\u007f", "\x7f")


def escape(value: Column, ascii_only: bool = False) -> Column:
    """``escaped`` as a column; JVM-side, the rare other control characters one by one."""
    marks = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    for raw, spelled in marks:
        value = F.replace(value, F.lit(raw), F.lit(spelled))
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    those = "\\x00-\\x1f\\x{80}-\\x{10ffff}" if ascii_only else "\\x00-\\x1f"
    test = f"[{those}]"

    def spell(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")
        rest = n - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(rest, 10)), unit(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))))
        return F.when(~c.rlike(test), c).when(n < 0x10000, unit(n)).otherwise(pair)

    return F.when(value.rlike(test), F.array_join(F.transform(F.regexp_extract_all(value, F.lit(f"{test}|[^{those}]+"), F.lit(0)), spell), "")).otherwise(value)
