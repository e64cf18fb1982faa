"""Queries built from the library's functions and operators, with the oracle's SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veilwork import facts
from veilwork.functions import detect, text as T
from veilwork.operators import evaluate, events, route, spans, vault
from veilwork.session import load
from veilwork.sources import fixtures

# What a receiver of redacted bodies must not see, and the stand-ins it should
LEAKS = {
    "ahv": r"\b756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}\b", "iban": r"\bCH[0-9]{2} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]\b", "phone": r"\+41 ?[0-9]{2} ?[0-9]{3} ?[0-9]{2} ?[0-9]{2}\b",
    "email": r"(?i)[a-z0-9_.+-]+@[a-z0-9_-]+\.[a-z]{2,}\b", "birthdate": r"\b(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{2}\b",
}
STANDIN = r"\[(?:PERSON|AHV|IBAN|ADDRESS|PHONE|EMAIL|BIRTHDATE|HEALTH|INSURANCE)_[0-9]+\]"

KEY = "test-key"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.findings(load(spark, sf_dir, "documents"))


# SQL of the validators, for the oracle: {v} is the value
DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"
EAN = "(10 - list_sum(list_transform(range(1, 13), lambda j: CAST(substr({x}, CAST(j AS integer), 1) AS integer) * CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10"


def weighed(weights: list[int], digits: str = DIGITS) -> str:
    return f"list_sum(list_transform(range(1, {len(weights) + 1}), lambda j: CAST(substr({digits}, CAST(j AS integer), 1) AS bigint) * ({weights})[j]))"


def luhn_sql(digits: str = DIGITS) -> str:
    twice = "(2 * CAST(substr(reverse({d}), CAST(j AS integer), 1) AS integer))".replace("{d}", digits)
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {twice} // 2 ELSE {twice} % 10 + {twice} // 10 END)) % 10 = 0"


LAST = f"CAST(right({DIGITS}, 1) AS integer)"
NIF = "substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST({n} % 23 + 1 AS integer), 1) = right({v}, 1)"
PLAIN = "upper(replace({v}, ' ', ''))"
VALID = {
    "IP_ADDRESS": "CASE WHEN contains({v}, ':') THEN len(regexp_extract_all({v}, '[0-9A-Fa-f]+')) <= CASE WHEN contains({v}, '::') THEN 7 ELSE 8 END ELSE len(list_filter(string_split({v}, '.'), lambda o: TRY_CAST(o AS integer) > 255)) = 0 END",
    "CREDIT_CARD_NUMBER": luhn_sql(),
    "INTERNATIONAL_BANKING_ACCOUNT_NUMBER": f"regexp_full_match({PLAIN}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split({PLAIN}[5:] || {PLAIN}[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS varchar) END), ''), ''), lambda c: CAST(c AS integer))), lambda r, c: (r * 10 + c) % 97) = 1",
    "AHV": f"{EAN.format(x=DIGITS)} = {LAST}",
    "ABA_ROUTING_NUMBER": f"{weighed([3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0",
    "UK_NHS": f"(11 - {weighed([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 = {LAST}",
    "ES_NIF": NIF.replace("{n}", "CAST(left({v}, 8) AS integer)"),
    "ES_NIE": NIF.replace("{n}", "CAST(translate(left({v}, 1), 'XYZ', '012') || substr({v}, 2, 7) AS integer)"),
    "PL_PESEL": f"(10 - {weighed([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {LAST}",
    "FI_PERSONAL_IDENTITY_CODE": "substr('0123456789ABCDEFHJKLMNPRSTUVWXY', CAST(CAST(left({v}, 6) || substr({v}, 8, 3) AS bigint) % 31 + 1 AS integer), 1) = right({v}, 1)",
    "AU_TAX_FILE_NUMBER": f"{weighed([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0",
    "IN_AADHAAR": f"""list_reduce(list_prepend(0, list_transform(range(1, 13), lambda j: CAST(substr((['0123456789', '1576283094', '5803796142', '8916043527', '9453126870', '4286573901', '2793806415', '7046913258'])[(j - 1) % 8 + 1], CAST(substr(reverse({DIGITS}), CAST(j AS integer), 1) AS integer) + 1, 1) AS bigint))),
        lambda a, b: CASE WHEN a < 5 THEN CASE WHEN b < 5 THEN (a + b) % 5 ELSE 5 + (a + b) % 5 END ELSE CASE WHEN b < 5 THEN 5 + (a - b + 5) % 5 ELSE (a - b + 5) % 5 END END) = 0""",
    "MEDICAL_LICENSE": f"{weighed([1, 2, 1, 2, 1, 2], DIGITS.replace('{v}', 'substr({v}, 3, 7)'))} % 10 = {LAST}",
    "IT_VAT_CODE": luhn_sql(),
    "AU_BUSINESS_NUMBER": f"({weighed([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0",
    "AU_COMPANY_NUMBER": f"(10 - {weighed([8, 7, 6, 5, 4, 3, 2, 1])} % 10) % 10 = {LAST}",
    "AU_MEDICAL_ACCOUNT_NUMBER": f"{weighed([1, 3, 7, 9, 1, 3, 7, 9])} % 10 = CAST(substr({DIGITS}, 9, 1) AS integer)",
    "KR_BRN": f"(10 - ({weighed([1, 3, 7, 1, 3, 7, 1, 3, 5])} + CAST(substr({DIGITS}, 9, 1) AS integer) * 5 // 10) % 10) % 10 = {LAST}",
    "TH_TNIN": f"(11 - {weighed([13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 10 = {LAST}",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found_sql(table: str = "documents") -> str:
    """The oracle's findings: the same patterns, positions from the gaps between matches over the whole text."""

    def of(r: detect.Recogniser) -> str:
        score = f"CASE WHEN {VALID[r.kind].replace('{v}', 'ms[i]')} THEN {r.score} ELSE {r.invalid_score} END" if r.valid else str(r.score)
        return f"""SELECT doc_id, '{r.kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS integer) AS start_, ms[i] AS value, CAST({score} AS double) AS score
      FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {quoted(r.pattern)}) AS ms, string_split_regex(text, {quoted(r.pattern)}) AS gaps FROM {table} WHERE regexp_matches(text, '[0-9@:]')) x WHERE len(ms) > 0) y"""

    return "f AS (" + " UNION ALL ".join(map(of, detect.RECOGNISERS)) + ")"


FOUND = found_sql()

def chosen_sql(table: str = "documents", who: str = "") -> str:
    """The chosen spans and their stand-ins, by recursion, and the redacted texts. who: SQL of what the stand-ins' key adds to KEY."""
    return f"""RECURSIVE {found_sql(table)}, sure AS (SELECT doc_id, kind, value, start_ AS s, start_ + length(value) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY start_, -length(value), kind) AS i, md5('{KEY}|' || {who}kind || '|' || value) AS d FROM f WHERE score >= {detect.THRESHOLD}),
greedy AS (SELECT *, true AS taken, e AS last FROM sure WHERE i = 1 UNION ALL SELECT x.*, x.s >= g.last, CASE WHEN x.s >= g.last THEN x.e ELSE g.last END FROM greedy g JOIN sure x ON x.doc_id = g.doc_id AND x.i = g.i + 1),
kept AS (SELECT doc_id, kind, value, s, e, CASE kind WHEN 'EMAIL_ADDRESS' THEN 'user.' || left(d, 8) || '@example.org' WHEN 'IP_ADDRESS' THEN '10.' || CAST('0x' || substr(d, 1, 2) AS integer) || '.' || CAST('0x' || substr(d, 3, 2) AS integer) || '.' || CAST('0x' || substr(d, 5, 2) AS integer)
    WHEN 'PHONE_NUMBER' THEN '+1 (555) ' || lpad(CAST(CAST('0x' || substr(d, 1, 6) AS bigint) % 1000 AS varchar), 3, '0') || '-' || lpad(CAST(CAST('0x' || substr(d, 7, 6) AS bigint) % 10000 AS varchar), 4, '0')
    WHEN 'CREDIT_CARD_NUMBER' THEN '4' || lpad(CAST(CAST('0x' || substr(d, 1, 6) AS bigint) % 10000000 AS varchar), 7, '0') || lpad(CAST(CAST('0x' || substr(d, 7, 6) AS bigint) % 10000000 AS varchar), 7, '0') ELSE '<' || kind || ':' || left(d, 8) || '>' END AS standin FROM greedy WHERE taken),
pieces AS (SELECT k.doc_id, k.kind, s, substr(d.text, coalesce(lag(e) OVER w, 0) + 1, s - coalesce(lag(e) OVER w, 0)) || standin AS piece, e FROM kept k JOIN {table} d ON k.doc_id = d.doc_id WINDOW w AS (PARTITION BY k.doc_id ORDER BY s)),
redacted AS (SELECT p.doc_id, count(*) AS n, list_sort(list(DISTINCT kind)) AS kinds, string_agg(piece, '' ORDER BY s) || substr(any_value(d.text), max(e) + 1) AS text FROM pieces p JOIN {table} d ON p.doc_id = d.doc_id GROUP BY p.doc_id)"""


CHOSEN = chosen_sql()


def chosen(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """One row a document with findings: doc_id, text, kept (its disjoint findings above the threshold, with stand-ins). All of it is
    worked out within the row."""
    rows = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", detect.found_in("text", kinds).alias("all"))
    sure = F.transform(F.filter("all", lambda x: x["score"] >= detect.THRESHOLD), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    rows = rows.withColumn("all", sure).withColumn("kept", spans.non_overlapping("all", "start, -(end - start), kind"))
    standin = lambda x: vault.standin(x["kind"], vault.digest(KEY, x["kind"], x["value"]))
    # not a filter: one would be pushed below the search, and have it done twice
    some = F.explode(F.filter(F.array(F.transform("kept", lambda x: x.withField("standin", standin(x)))), lambda k: F.size(k) > 0))
    return rows.select("doc_id", "text", some.alias("kept"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosen(spark, sf_dir)
    # a kind without facts (AHV) has no risk level
    risk = F.create_map(*[F.lit(x) for f in facts.FACTS for x in (f[0], f[2])])
    return rows.select("doc_id", F.size("kept").alias("n_spans"), F.array_sort(F.array_distinct("kept.kind")).alias("kinds"), F.length(spans.splice("text", "kept")).alias("redacted_len"), F.array_max(F.transform("kept.kind", lambda k: F.try_element_at(risk, k))).alias("risk_max"))


def regex_entities(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", "kind", F.col("start").alias("start_"), "value", F.col("score").cast("double").alias("score"))


def near_misses(spark, sf_dir):
    """Addresses of hosts in log lines, some with a part beyond 255."""
    lines = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("from 10.0."), F.col("event_id") % 400, F.lit(".1 at x@example.org")).alias("text"))
    return detect.findings(lines).where(F.col("score") < detect.THRESHOLD).select("doc_id", "kind", "value")


def detection_summary(spark, sf_dir):
    return found(spark, sf_dir).where(F.col("score") >= detect.THRESHOLD).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", F.lit(0.5)), 6).alias("median"), F.countDistinct("kind").alias("n_kinds"))


def distinct_tokens(spark, sf_dir):
    return found(spark, sf_dir).groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min_by("start", F.struct("doc_id", "start")).alias("first_at"))


def suppressed_counts(spark, sf_dir):
    return found(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("found"), F.count_if(F.col("score") >= detect.THRESHOLD).alias("applied"), F.count_if(F.col("score") < detect.THRESHOLD).alias("suppressed"))


def pii_facts_join(spark, sf_dir):
    return facts.with_facts(found(spark, sf_dir)).groupBy("kind", "information_type", "risk_level", "hipaa_category").agg(F.count("*").alias("n"))


def standin_map(spark, sf_dir):
    d = vault.digest(KEY, F.col("kind"), F.col("value"))
    return found(spark, sf_dir).select("kind", "value").distinct().withColumn("standin", F.concat("kind", F.lit("_"), F.left(d, F.lit(12))))


def standin_collisions(spark, sf_dir):
    pairs = found(spark, sf_dir).select(F.lit("c").alias("client"), F.lit("h").alias("host"), "kind", "value").distinct().withColumn("standin", F.left(vault.digest(KEY, F.col("kind"), F.col("value")), F.lit(1)))
    return vault.collisions(pairs).select("standin", "n_values")


def redact_text(spark, sf_dir):
    rows = chosen(spark, sf_dir)
    return rows.select("doc_id", F.size("kept").alias("n_spans"), F.md5(spans.splice("text", "kept").cast("binary")).alias("digest"))


def recogniser_findings(spark, sf_dir):
    """Every kind over records that have its shape, with valid and invalid check digits."""
    rows = detect.findings(fixtures.records(spark, sf_dir))
    return rows.select("doc_id", "kind", F.col("start").alias("start_"), "value", F.col("score").cast("double").alias("score"))


def restore_roundtrip(spark, sf_dir):
    rows = chosen(spark, sf_dir)
    pairs = rows.select(F.lit("c").alias("client"), F.col("doc_id").cast("string").alias("host"), F.explode("kept").alias("k")).select("client", "host", "k.standin", "k.value").distinct()
    texts = rows.select(F.lit("c").alias("client"), F.col("doc_id").cast("string").alias("host"), "doc_id", spans.splice("text", "kept").alias("text"))
    back = vault.restore(texts, pairs)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def non_overlapping_spans(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.expr("cast(o_orderkey % 100 as int) as start"), F.expr("cast(o_orderkey % 100 + 1 + o_orderkey % 7 as int) as end")).distinct()
    each = rows.groupBy("o_custkey").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return each.select("o_custkey", F.explode(spans.non_overlapping("s")).alias("k")).select("o_custkey", F.col("k.start").alias("s"), F.col("k.end").alias("e"))


def place_findings(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("length(text) > 40").withColumn("value", F.substring("text", 21, 6))
    at = spans.place(F.col("text"), F.col("value"), F.lit(20))
    moved = spans.place(F.substring(F.col("text"), F.lit(6), F.length("text")), F.col("value"), F.lit(20))
    return d.select("doc_id", at.alias("at_"), moved.alias("moved"))


def covered_chars(spark, sf_dir):
    a = load(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("s"), (F.col("o_orderkey") % 50 + 10).alias("e"), "o_orderkey")
    b = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 40).alias("s2"), (F.col("c_custkey") % 40 + 15).alias("e2"))
    return a.join(b, "o_custkey").groupBy("o_custkey").agg(F.sum(spans.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("covered"))


def host_rules(spark, sf_dir):
    h = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return load(spark, sf_dir, "pages").select("page_id", route.covers("*.example.net", h).alias("net"), route.covers("example.org.", h).alias("org"), route.path_allowed([("example.com", ["/en/", "/de/"])], h, F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)).alias("in_scope"))


CONTENT_TYPES = ("text/html; charset=utf-8", "application/json", "text/css", "application/problem+json", "image/png", "text/event-stream", "application/javascript", "application/xml")


def content_gate(spark, sf_dir):
    ct = F.element_at(F.array(*[F.lit(c) for c in CONTENT_TYPES]), (F.col("page_id") % len(CONTENT_TYPES) + 1).cast("int"))
    rows = load(spark, sf_dir, "pages").select("page_id", ct.alias("ct"))
    return rows.select("page_id", "ct", route.inspectable(F.col("ct")).alias("inspectable"), route.textual(F.col("ct")).alias("textual"), route.body_syntax(F.col("ct")).alias("syntax"))


def single_line(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.single_line(F.col("text")).cast("binary")).alias("digest"))


def fold_local_part(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", T.fold_local_part(F.concat(F.lit("Käthi O'"), "c_name", F.lit(" "), "c_mktsegment")).alias("local_part"))


def levenshtein_ratio(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.round(T.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


def excerpt_around(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", T.excerpt(F.col("text"), F.substring("text", 31, 5), 24).alias("excerpt"))


def format_bytes(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", T.format_bytes((F.col("o_totalprice") * 10).cast("bigint")).alias("size"))


def ean13_check(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", T.ean13_check(F.concat(F.lit("756"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).alias("check_digit"))


def iban_check(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", T.iban_check("1217", F.lpad(F.col("c_custkey").cast("string"), 17, "0")).alias("check_digits"))


def scanned(spark, sf_dir):
    """Documents and tickets as a receiver sees them: the tickets hold the kinds that documents lack."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return docs.unionByName(fixtures.tickets(spark, sf_dir).select(F.concat(F.lit("t"), "doc_id").alias("id"), "text"))


def leak_scan(spark, sf_dir):
    return scanned(spark, sf_dir).select("id", *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(k) for k, p in {**LEAKS, "tokens": STANDIN}.items()])


def leak_scan_totals(spark, sf_dir):
    rows = leak_scan(spark, sf_dir)
    return rows.agg(*[F.count_if(F.col(k) > 0).alias(f"with_{k}") for k in LEAKS], F.count_if(sum((F.col(k) for k in LEAKS), F.lit(0)) > 0).alias("saw_raw"), F.count_if(F.col("tokens") > 0).alias("saw_tokens"), F.sum("email").alias("emails"))


def elapsed_ms(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("before", F.lag("ts").over(w))
    return rows.select("event_id", F.floor((ms("ts") - ms("before")) / 1000).cast("bigint").alias("elapsed"))


def embedding_dot(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return e.join(one, F.lit(True)).select("vec_id", F.round(evaluate.dot(F.col("embedding"), F.col("q")), 4).alias("dot"))


def topk_similarity(spark, sf_dir):
    return embedding_dot(spark, sf_dir).orderBy(F.desc("dot"), "vec_id").limit(10)


def similarity_zscore(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("s"))
    return evaluate.with_zscore(e, "s", "label", "z").select("vec_id", F.round("z", 4).alias("z"))


def softmax_rank(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("s"))
    return evaluate.with_softmax(e, "s", "label", "p").select("vec_id", F.round("p", 6).alias("p"))


def dp_latent_bound(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: 3 * F.tanh(x.cast("double"))), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def asof_segment(spark, sf_dir):
    a = load(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    b = load(spark, sf_dir, "events").where(F.col("event_type") == "view").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return events.as_of(a, b, "user_id", "ts", "view_id", "event_id")


def vault_sessions(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"))
    return vault.sessions(e, "8 hours").groupBy("client").agg(F.count("*").alias("n_sessions"), F.max("n_accesses").alias("most"))


def tumbling_traffic(spark, sf_dir):
    return events.traffic(load(spark, sf_dir, "events"), "1 day")


def sliding_traffic(spark, sf_dir):
    return events.traffic(load(spark, sf_dir, "events"), "1 day", "12 hours")


def gazetteer_hits(spark, sf_dir):
    return evaluate.gazetteer_hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def synth_persons(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    base = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("id"), F.concat(F.initcap("n_name"), F.lit(" "), F.initcap("r_name")).alias("name"))
    digits = F.concat(F.lit("756"), F.lpad((F.col("id") * 7919).cast("string"), 9, "0"))
    return base.select("id", "name", F.concat(digits, T.ean13_check(digits).cast("string")).alias("ahv"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (regex_entities, near_misses, detection_summary, distinct_tokens, suppressed_counts, pii_facts_join, standin_map, standin_collisions, redact_text, recogniser_findings, restore_roundtrip, non_overlapping_spans, place_findings, covered_chars, host_rules, content_gate, single_line, fold_local_part, levenshtein_ratio, excerpt_around, format_bytes, ean13_check, iban_check, leak_scan, leak_scan_totals, elapsed_ms, embedding_dot, topk_similarity, similarity_zscore, softmax_rank, dp_latent_bound, asof_segment, vault_sessions, tumbling_traffic, sliding_traffic, gazetteer_hits, synth_persons)
} | {"redacted_documents": flagship}

SCANNED = f"s AS (SELECT 'd' || doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 't' || doc_id, text FROM ({fixtures.TICKETS.format(customer='customer')}) t)"
COUNTED = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in {**LEAKS, "tokens": STANDIN}.items())
DOT = "round(list_dot_product(CAST(e.embedding AS double[]), CAST(q.embedding AS double[])), 4)"

ORACLE: dict[str, str] = {
    "redacted_documents": f"WITH {CHOSEN}, k(kind, risk) AS (VALUES {', '.join(f'({quoted(x[0])}, {x[2]})' for x in facts.FACTS)}) SELECT doc_id, CAST(n AS integer) AS n_spans, kinds, CAST(length(text) AS integer) AS redacted_len, (SELECT max(risk) FROM k WHERE list_contains(kinds, kind)) AS risk_max FROM redacted",
    "redact_text": f"WITH {CHOSEN} SELECT doc_id, CAST(n AS integer) AS n_spans, md5(text) AS digest FROM redacted",
    "recogniser_findings": f"WITH records AS MATERIALIZED ({fixtures.records_sql('customer', 'varchar')}), {found_sql('records')} SELECT doc_id, kind, start_, value, score FROM f",
    "regex_entities": f"WITH {FOUND} SELECT doc_id, kind, start_, value, CAST(score AS double) AS score FROM f",
    "near_misses": "SELECT event_id AS doc_id, 'IP_ADDRESS' AS kind, '10.0.' || event_id % 400 || '.1' AS value FROM events WHERE event_id % 400 > 255",
    "detection_summary": f"WITH {FOUND} SELECT doc_id, count(*) AS n, round(avg(CAST(score AS double)), 6) AS mean, round(median(CAST(score AS double)), 6) AS median, count(DISTINCT kind) AS n_kinds FROM f WHERE score >= 0.6 GROUP BY doc_id",
    "distinct_tokens": f"WITH {FOUND} SELECT kind, value, count(*) AS n, min(doc_id) AS first_doc, arg_min(start_, doc_id * 1000000 + start_) AS first_at FROM f GROUP BY kind, value",
    "suppressed_counts": f"WITH {FOUND} SELECT kind, count(*) AS found, count(*) FILTER (score >= 0.6) AS applied, count(*) FILTER (score < 0.6) AS suppressed FROM f GROUP BY kind",
    "pii_facts_join": f"WITH {FOUND}, k(kind, information_type, risk_level, hipaa_category) AS (VALUES {facts.sql_values()}) SELECT f.kind, information_type, risk_level, hipaa_category, count(*) AS n FROM f JOIN k ON f.kind = k.kind GROUP BY ALL",
    "standin_map": f"WITH {FOUND} SELECT DISTINCT kind, value, kind || '_' || left(md5('{KEY}|' || kind || '|' || value), 12) AS standin FROM f",
    "standin_collisions": f"WITH {FOUND}, p AS (SELECT DISTINCT kind, value, left(md5('{KEY}|' || kind || '|' || value), 1) AS standin FROM f) SELECT standin, count(*) AS n_values FROM p GROUP BY standin HAVING count(*) > 1",
    "restore_roundtrip": f"WITH {FOUND} SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM f WHERE score >= 0.6)",
    "non_overlapping_spans": """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, s - e) AS i FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey % 100 AS integer) AS s, CAST(o_orderkey % 100 + 1 + o_orderkey % 7 AS integer) AS e FROM orders) x),
        r AS (SELECT o_custkey, i, s, e, true AS kept, e AS last FROM s WHERE i = 1 UNION ALL SELECT s.o_custkey, s.i, s.s, s.e, s.s >= r.last, CASE WHEN s.s >= r.last THEN s.e ELSE r.last END FROM r JOIN s ON s.o_custkey = r.o_custkey AND s.i = r.i + 1)
        SELECT o_custkey, s, e FROM r WHERE kept""",
    "place_findings": """WITH d AS (SELECT doc_id, substr(text, 21, 6) AS v, substr(text, 6) AS m FROM documents WHERE length(text) > 40)
        SELECT doc_id, 20 AS at_, CAST(CASE WHEN substr(m, 21, 6) = v THEN 20 WHEN instr(substr(m, 22), v) > 0 THEN instr(substr(m, 22), v) + 20 WHEN instr(m, v) > 0 THEN instr(m, v) - 1 ELSE -1 END AS integer) AS moved FROM d""",
    "covered_chars": "SELECT o_custkey, CAST(sum(greatest(0, least(o_orderkey % 50 + 10, c_custkey % 40 + 15) - greatest(o_orderkey % 50, c_custkey % 40))) AS bigint) AS covered FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey",
    "host_rules": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
        SELECT page_id, (h = 'example.net' OR ends_with(h, '.example.net')) AS net, (h = 'example.org' OR ends_with(h, '.example.org')) AS org, CASE WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN starts_with(path, '/en/') OR starts_with(path, '/de/') ELSE true END AS in_scope FROM p""",
    "content_gate": f"""WITH p AS (SELECT page_id, ({list(CONTENT_TYPES)})[page_id % {len(CONTENT_TYPES)} + 1] AS ct FROM pages), t AS (SELECT *, lower(trim(split_part(ct, ';', 1))) AS m FROM p)
        SELECT page_id, ct, (m LIKE 'text/%' OR m LIKE '%json' OR m LIKE '%xml' OR m = 'application/x-www-form-urlencoded') AND NOT (m LIKE '%javascript' OR m LIKE '%ecmascript' OR m = 'text/css') AND m <> 'text/event-stream' AS inspectable, regexp_matches(lower(ct), 'json|text') AS textual, CASE WHEN lower(ct) LIKE '%json%' OR m = 'text/event-stream' THEN 'Json' ELSE 'Text' END AS syntax FROM t""",
    "single_line": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g'))) AS digest FROM documents",
    "fold_local_part": r"SELECT c_custkey, regexp_replace(regexp_replace(replace(replace(replace(lower('Käthi O''' || c_name || ' ' || c_mktsegment), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[''\s]+', '.', 'g'), '[^a-z.-]', '', 'g') AS local_part FROM customer",
    "levenshtein_ratio": "SELECT p_partkey, round(CAST(length(p_name) + length(p_type) - levenshtein(p_name, p_type) AS double) / (length(p_name) + length(p_type)), 9) AS ratio FROM part",
    "excerpt_around": """WITH d AS (SELECT doc_id, text, instr(text, substr(text, 31, 5)) - 1 AS i, length(substr(text, 31, 5)) AS n FROM documents WHERE length(text) > 0), e AS (SELECT *, CASE WHEN n > 0 THEN i ELSE -1 END AS at_, (24 - n) // 2 AS pad FROM d)
        SELECT doc_id, CASE WHEN at_ < 0 THEN substr(text, 1, 24) || CASE WHEN length(text) > 24 THEN '…' ELSE '' END ELSE CASE WHEN at_ > pad THEN '…' ELSE '' END || substr(text, greatest(0, at_ - pad) + 1, at_ + n + pad - greatest(0, at_ - pad)) || CASE WHEN at_ + n + pad < length(text) THEN '…' ELSE '' END END AS excerpt FROM e""",
    "format_bytes": "WITH o AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 10) AS bigint) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f kB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size FROM o",
    "ean13_check": f"SELECT c_custkey, CAST({EAN.format(x="('756' || lpad(CAST(c_custkey AS varchar), 9, '0'))")} AS integer) AS check_digit FROM customer",
    "iban_check": "SELECT c_custkey, lpad(CAST(98 - CAST(lpad(CAST(c_custkey AS varchar), 17, '0') || '121700' AS hugeint) % 97 AS varchar), 2, '0') AS check_digits FROM customer",
    "leak_scan": f"WITH {SCANNED} SELECT id, {COUNTED} FROM s",
    "leak_scan_totals": f"WITH {SCANNED}, c AS (SELECT {COUNTED} FROM s) SELECT {', '.join(f'count(*) FILTER ({k} > 0) AS with_{k}' for k in LEAKS)}, count(*) FILTER ({' + '.join(LEAKS)} > 0) AS saw_raw, count(*) FILTER (tokens > 0) AS saw_tokens, CAST(sum(email) AS bigint) AS emails FROM c",
    "elapsed_ms": "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000) AS bigint) AS elapsed FROM events",
    "embedding_dot": f"SELECT e.vec_id, {DOT} AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    "topk_similarity": f"SELECT e.vec_id, {DOT} AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY dot DESC, e.vec_id LIMIT 10",
    "similarity_zscore": "SELECT vec_id, round(CASE WHEN sd = 0 THEN 0 ELSE (s - m) / sd END, 4) AS z FROM (SELECT vec_id, s, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd FROM (SELECT vec_id, label, CAST(embedding[1] AS double) AS s FROM embeddings) x WINDOW w AS (PARTITION BY label)) y",
    "softmax_rank": "SELECT vec_id, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY label), 6) AS p FROM (SELECT vec_id, label, s, max(s) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, CAST(embedding[1] AS double) AS s FROM embeddings) x) y",
    "dp_latent_bound": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 3 * tanh(CAST(x AS double)))), 4) AS total FROM embeddings",
    "asof_segment": "SELECT a.event_id, b.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts",
    "vault_sessions": "WITH l AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOURS THEN 0 ELSE 1 END AS starts, ts FROM events), s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id AS client, count(*) AS n_sessions, max(n) AS most FROM c GROUP BY user_id",
    "tumbling_traffic": "SELECT epoch_ms(date_trunc('day', ts)) AS window_ms, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "sliding_traffic": "WITH s AS (SELECT *, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events), w AS (SELECT b AS w, event_type, value FROM s UNION ALL SELECT b - INTERVAL 12 HOURS, event_type, value FROM s) SELECT epoch_ms(w) AS window_ms, event_type, count(*) AS n, round(sum(value), 3) AS total FROM w GROUP BY ALL",
    "gazetteer_hits": r"WITH c AS MATERIALIZED (SELECT d.doc_id, b.item_id, d.text, b.text AS literal FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)) SELECT doc_id, item_id FROM c WHERE regexp_matches(text, '(^|[^\p{L}\d.])' || regexp_escape(literal) || '($|[^\p{L}\d])')",
    "synth_persons": f"WITH p AS (SELECT n_nationkey AS id, upper(n_name[1]) || lower(n_name[2:]) || ' ' || array_to_string(list_transform(string_split(r_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, '756' || lpad(CAST(n_nationkey * 7919 AS varchar), 9, '0') AS d FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT id, name, d || {EAN.format(x='d')} AS ahv FROM p",
}
