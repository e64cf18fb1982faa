"""Message bodies: decompression and decoding, with a bound on what a body may grow to."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Window sizes of the content encodings that can be undone; charsets that are known
WINDOWS = {"gzip": 31, "x-gzip": 31, "deflate": 15}
CHARSETS = {"utf-8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16be": "UTF-16BE", "utf-16le": "UTF-16LE", "latin1": "ISO-8859-1", "ascii": "US-ASCII"}


def within(body: Column, limit: int) -> Column:
    """Whether a body may be read: at most limit bytes; no limit if that is 0."""
    return F.lit(limit <= 0) | (F.octet_length(body) <= limit)


def files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """path, length, body of the files below a path; body is null for those of more than limit bytes (0: none are). The limit is a
    filter of the file source, which knows a file's length before it opens it: an oversize file is listed, and never read. Empty files are not listed, as Spark skips them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if limit <= 0:
        return listed.select("path", "length", F.col("content").alias("body"))
    read = listed.where(F.col("length") <= limit).select("path", "length", F.col("content").alias("body"))
    return read.unionByName(listed.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("body")))


def undone(body: bytes | None, encoding: str | None, limit: int) -> bytes | None:
    """The body without its content encoding; null for other encodings, damaged bodies, and bodies beyond the limit (0: none)."""
    name, most = (encoding or "").strip().lower(), limit if limit > 0 else (1 << 31) - 2
    if body is None or name in ("", "identity"):
        return body if body is None or len(body) <= most else None
    if name not in WINDOWS:
        return None
    try:
        pump = zlib.decompressobj(WINDOWS[name])
        out = pump.decompress(bytes(body), most + 1)
    except zlib.error:
        return None
    return out if len(out) <= most and pump.eof else None


def inflated(limit: int):
    """UDF (body, encoding) -> body: identity, gzip and deflate are undone; null for other encodings, damaged bodies, and bodies
    that grow beyond the limit, which are left alone. No more than limit + 1 bytes are ever made of one."""

    @F.pandas_udf("binary")
    def run(body: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([undone(b, e, limit) for b, e in zip(body, encoding)], dtype=object)

    return run


def charset(content_type: Column) -> Column:
    """The charset a content type declares, UTF-8 if none or unknown."""
    declared = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i);\s*charset\s*=\s*\"?([^\s;\"]+)", 1))
    out = None
    for name, known in CHARSETS.items():
        out = F.when(declared == name, known) if out is None else out.when(declared == name, known)
    return out.otherwise("UTF-8")


def decoded(body: Column, content_type: Column) -> Column:
    """body as text by its charset; ill-formed sequences become replacement characters."""
    name = charset(content_type)
    out = None
    for known in sorted({*CHARSETS.values()}):
        text = F.try_validate_utf8(body.cast("string")) if known == "UTF-8" else F.decode(F.when(name == known, body), known)
        out = F.when(name == known, text) if out is None else out.when(name == known, text)
    return F.coalesce(out, F.make_valid_utf8(body.cast("string")))


def declared_names(header: Column) -> Column:
    """The names of a header: base64 of UTF-8, parted by bars; empty ones go."""
    return F.filter(F.split(F.decode(F.unbase64(F.coalesce(header, F.lit(""))), "UTF-8"), r"\|"), lambda n: n != "")
