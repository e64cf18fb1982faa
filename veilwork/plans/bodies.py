"""Queries of the data path: bodies redacted in place, restored, and what a detector answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.functions import detect
from veilwork.operators import jsontext, mutation, names, truth
from veilwork.plans import privacy
from veilwork.session import load, settled
from veilwork.sources import fixtures, policy


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message a record: JSON in either spelling (every fourth of them cut off, so none), or plain text; every ninth says that it is
    compressed, and is not."""
    text = F.concat("text", F.lit('\nby "Müller" \\ 😀'))
    spelled = F.when(F.col("doc_id") % 2 == 0, jsontext.escape(text)).otherwise(jsontext.escape(text, True))
    body = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "note" : "'), spelled, F.lit('", // kept\n "list": ["a@example.org", 7, {"deep": ""}]}'))
    kind = F.col("doc_id") % 8
    body = F.when(kind == 3, text).when(kind == 5, F.concat(body, F.lit("}"))).otherwise(body)
    return fixtures.records(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string")).alias("client"), F.concat(F.lit("h"), (F.col("doc_id") % 3).cast("string")).alias("host"),
        F.encode(body, "UTF-8").alias("body"), F.when(kind == 3, "text/plain").otherwise("application/json; charset=utf-8").alias("content_type"), F.when(F.col("doc_id") % 9 == 0, "gzip").alias("content_encoding"),
    )


def redacted_bodies(spark, sf_dir):
    rows = mutation.redacted(messages(spark, sf_dir), privacy.KEY)
    return rows.select("doc_id", "status", F.md5(F.encode("redacted", "UTF-8")).alias("digest"), F.length("redacted").alias("size"), F.size("tokens").alias("n_tokens"))


def restored_bodies(spark, sf_dir):
    """The redacted bodies as their own responses: those of the same client and host come back as they were."""
    sent = mutation.redacted_apart(messages(spark, sf_dir), privacy.KEY)
    answers = sent.select("doc_id", "client", "host", F.coalesce(F.encode("redacted", "UTF-8"), F.col("body")).alias("body"), "content_type", "content_encoding")
    back = mutation.restored(answers, mutation.tokens_of(sent))
    return back.select("doc_id", "status", F.md5("restored").alias("digest"), (F.col("n_restored") > 0).alias("any"))


def analysis_shapes(spark, sf_dir):
    """What a detector answers for each line of the records: nothing, only what it ignored, or its results."""
    lines = fixtures.records(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    found = lines.select("doc_id", "line", detect.found_in("text").alias("found"))
    return found.select("doc_id", "line", detect.answer("found").alias("answer"))


def split_pieces(spark, sf_dir):
    """Texts cut at needles: the earliest wins, of one place the longest."""
    d = load(spark, sf_dir, "part")
    pieces = mutation.split_by("p_name", ["a", "an", "e", "in ", "in"])
    return d.select("p_partkey", F.explode(pieces).alias("p")).groupBy("p_partkey").agg(F.count("*").alias("n"), F.sum(F.length("p.text")).alias("chars"), F.count_if(F.col("p.span") == 1).alias("n_an"), F.count_if(F.col("p.span").isNull()).alias("n_between"), F.count_if(F.col("p.span") == 3).alias("n_in_blank"))


def policy_merge(spark, sf_dir):
    """A policy file a customer: missing, no JSON, a list, given in part, of a wrong type, or with further keys."""
    given = ("", "{not json", "[1]", '{"keep": ["Kim"]}', '{"redact": "DATE", "keep": [1, 2]}', '{"redact": ["DATE"], "keep": [], "more": {"a": 1}}')
    text = F.element_at(F.array(F.lit(None), *[F.lit(g) for g in given]), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", policy.merged(text, policy.POLICY).alias("p"), policy.merged(F.concat(F.lit('{"ttl_hours": '), F.col("c_custkey").cast("string"), F.lit(', "threshold": 1, "inspect": "no"}')), policy.SETTINGS).alias("s"))
    of = lambda v, k: policy.policy_of(F.lit(v), F.lit(k), F.col("p"))
    return rows.select("c_custkey", of("Kim", "PERSON").alias("kim"), of("1980-01-02", "DATE").alias("date"), F.size("p.redact").alias("n_redact"), F.col("s.ttl_hours").alias("ttl_hours"), F.col("s.threshold").alias("threshold"), F.col("s.inspect").alias("inspect"), F.col("s.clients").alias("clients"))


def name_labels(spark, sf_dir):
    """PERSON, ORG and LOCATION by a sequence labeller that has learned from three quarters of the tickets, in the rest."""
    docs = settled(fixtures.tickets(spark, sf_dir))
    known = settled(truth.entities(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    weights = names.learned(docs.where(~held), known.where(~held), ["PERSON", "ORG", "LOCATION"])
    return names.findings(docs.where(held), weights)


QUERIES = {f.__name__: f for f in (redacted_bodies, restored_bodies, analysis_shapes, split_pieces, policy_merge, name_labels)}

SPELLED = """array_to_string(list_transform(string_split({t}, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' {more} ELSE c END), '')"""
ASCII = "WHEN unicode(c) > 65535 THEN '\\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) WHEN unicode(c) > 127 THEN '\\u' || printf('%04x', unicode(c))"
TAIL = """ || chr(10) || 'by "Müller" \\ 😀'"""
WHO = "'c' || doc_id % 7 || '|h' || doc_id % 3 || '|' || "


def body_sql(text: str, mail: str) -> str:
    """A message of the text, and with that mail in its list."""
    spelled = f"CASE WHEN doc_id % 2 = 0 THEN {SPELLED.replace('{t}', text).replace('{more}', '')} ELSE {SPELLED.replace('{t}', text).replace('{more}', ASCII)} END"
    return f"""CASE WHEN doc_id % 8 = 3 THEN {text} ELSE '{{"id": ' || doc_id || ', "note" : "' || {spelled} || '", // kept' || chr(10) || ' "list": ["' || {mail} || '", 7, {{"deep": ""}}]}}' || CASE WHEN doc_id % 8 = 5 THEN '}}' ELSE '' END END"""


RECORDS = f"MATERIALIZED ({fixtures.records_sql('customer', 'varchar')})"
MAIL = f"('user.' || left(md5('{privacy.KEY}|' || {WHO}'EMAIL_ADDRESS|a@example.org'), 8) || '@example.org')"
#: Messages of redacted records: outside of the stand-ins, they must be the messages themselves. Spelling is by character, so
#: it may come after the redaction. Bodies that are no JSON are texts, whose values may differ: they are searched as a whole.
BODIES = privacy.chosen_sql("texts", WHO).replace("RECURSIVE ", f"RECURSIVE records AS {RECORDS}, texts AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 8 = 5 THEN {body_sql('(text' + TAIL + ')', chr(39) + 'a@example.org' + chr(39))} ELSE text{TAIL} END AS text FROM records), ", 1)
SHAPES = "CASE WHEN n = 0 AND ignored IS NULL THEN '{}' WHEN n = 0 THEN '{\"ignored_results\":[' || ignored || ']}' ELSE '{\"mean\":' || mean || ',\"frequencies\":{' || kinds || '},\"results\":[' || results || ']' || CASE WHEN ignored IS NULL THEN '' ELSE ',\"ignored_results\":[' || ignored || ']' END || '}' END"

ORACLE = {
    "policy_merge": "SELECT c_custkey, CASE c_custkey % 7 WHEN 4 THEN 'keep' WHEN 6 THEN 'informational' ELSE 'redact' END AS kim, CASE WHEN c_custkey % 7 = 6 THEN 'redact' ELSE 'informational' END AS date, CASE WHEN c_custkey % 7 = 6 THEN 1 ELSE 7 END AS n_redact, c_custkey AS ttl_hours, 1.0 AS threshold, true AS inspect, 512 AS clients FROM customer",
    "redacted_bodies": f"""WITH {BODIES}, m AS (SELECT r.doc_id, CASE WHEN r.doc_id % 8 = 5 THEN d.text WHEN r.doc_id % 9 <> 0 THEN {body_sql('d.text', MAIL).replace('doc_id', 'r.doc_id')} END AS body FROM records r JOIN redacted d ON r.doc_id = d.doc_id),
        n AS (SELECT doc_id, count(DISTINCT kind || '|' || value) AS n FROM (SELECT doc_id, kind, value FROM kept UNION ALL SELECT doc_id, 'EMAIL_ADDRESS', 'a@example.org' FROM records WHERE doc_id % 8 NOT IN (3, 5)) x GROUP BY doc_id)
        SELECT m.doc_id, CASE WHEN m.doc_id % 9 = 0 THEN 'refused' ELSE 'treated' END AS status, CASE WHEN m.doc_id % 9 <> 0 THEN md5(body) END AS digest, CASE WHEN m.doc_id % 9 <> 0 THEN CAST(length(body) AS integer) END AS size, CAST(CASE WHEN m.doc_id % 9 = 0 THEN 0 ELSE n END AS integer) AS n_tokens FROM m JOIN n ON m.doc_id = n.doc_id""",
    "restored_bodies": f"WITH records AS {RECORDS}, t AS (SELECT doc_id, text{TAIL} AS t FROM records) SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'kept' ELSE 'restored' END AS status, md5({body_sql('t', chr(39) + 'a@example.org' + chr(39))}) AS digest, doc_id % 9 <> 0 AS any FROM t",
    "split_pieces": """WITH RECURSIVE s AS (SELECT p_partkey, p_name AS rest, '' AS piece, 0 AS kind, true AS first FROM part
        UNION ALL SELECT p_partkey, substr(rest, CASE WHEN at_ = 0 THEN length(rest) WHEN at_ > 1 THEN at_ - 1 ELSE length(hit) END + 1), CASE WHEN at_ = 0 THEN rest WHEN at_ > 1 THEN left(rest, at_ - 1) ELSE hit END, CASE WHEN at_ = 1 AND hit = 'an' THEN 1 WHEN at_ = 1 AND hit = 'in ' THEN 3 WHEN at_ = 1 THEN 9 ELSE 2 END, false
        FROM (SELECT p_partkey, rest, regexp_extract(rest, 'an|a|e|in |in') AS hit, CASE WHEN regexp_matches(rest, 'an|a|e|in |in') THEN instr(rest, regexp_extract(rest, 'an|a|e|in |in')) ELSE 0 END AS at_ FROM s WHERE rest <> '') x)
        SELECT p_partkey, count(*) AS n, CAST(sum(length(piece)) AS bigint) AS chars, count(*) FILTER (kind = 1) AS n_an, count(*) FILTER (kind = 2) AS n_between, count(*) FILTER (kind = 3) AS n_in_blank FROM s WHERE NOT first GROUP BY p_partkey""",
    "analysis_shapes": f"""WITH RECURSIVE lines AS (SELECT doc_id * 1000 + line AS doc_id, text FROM (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({fixtures.records_sql('customer', 'varchar')}) r) q) p), {privacy.found_sql('lines')},
        i AS (SELECT *, score >= 0.6 AS sure, '{{"kind":"' || kind || '","start":' || start_ || ',"end":' || start_ + length(value) || ',"text":"' || value || '","score":' || score || '}}' AS item FROM f),
        k AS (SELECT doc_id, string_agg('"' || kind || '":' || c, ',' ORDER BY kind) AS kinds FROM (SELECT doc_id, kind, count(*) AS c FROM i WHERE sure GROUP BY doc_id, kind) x GROUP BY doc_id),
        a AS (SELECT l.doc_id, count(*) FILTER (sure) AS n, avg(score) FILTER (sure) AS mean, string_agg(item, ',' ORDER BY start_, kind) FILTER (sure) AS results, string_agg(item, ',' ORDER BY start_, kind) FILTER (NOT sure) AS ignored FROM lines l LEFT JOIN i ON l.doc_id = i.doc_id GROUP BY l.doc_id)
        SELECT doc_id // 1000 AS doc_id, CAST(doc_id % 1000 AS integer) AS line, {SHAPES} AS answer FROM (SELECT a.doc_id, n, CAST(round(mean, 6) AS varchar) AS mean, results, ignored, kinds FROM a LEFT JOIN k ON a.doc_id = k.doc_id) z""",
}
