"""Queries of the traffic side: routing, bodies, vault, telemetry, risk and sources, with SQL of their own for each.

Events stand for requests: their type for what became of them, value for size and time, user for the client.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.functions import text as T
from veilwork.operators import compare, jsontext, ranks, risk, route, telemetry, vault
from veilwork.plans import privacy
from veilwork.session import load, settled, spread
from veilwork.sources import bodies, corpus

AGENTS = ("Mozilla (iPad)", "Tablet UA", "Mozilla (iPhone)", "Android 14", "Macintosh", "X11; Linux", "curl/8", "")
TYPES = ("application/json; charset=utf-8", "text/css", "image/png", "font/woff2", "application/javascript", "text/html; charset=\"ISO-8859-1\"", "application/xml;charset=utf-16le", "text/plain; charset=windows-1252", "odd", "")
BLOCKS = ((1, "example.net", "/en/1"), (2, "*.example.org", "/de/"))
DETOURS = ((1, "example.com", "/fr/", "https://other.example.net/fr/"), (2, "Example.Org.", "/", "https://www.example.org/"), (3, "example.com", "/", "https://last.example.com/"))
HIDDEN = ("www.example.com", "m.example.net")


def pick(values: tuple, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def picked(values: tuple, n: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({n} % {len(values)} AS integer) + 1]"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type", F.when(F.col("event_id") % 19 != 0, (F.col("value") * 10_000).cast("bigint")).otherwise(F.lit(0)).alias("size"), "value", "props")


#: Requests in SQL, as ``requests`` gives them.
R = "r AS (SELECT event_id, epoch_us(ts) // 1000 AS \"at\", user_id, event_type, CASE WHEN event_id % 19 <> 0 THEN CAST(trunc(value * 10000) AS bigint) ELSE 0 END AS size, value, props FROM events)"


def treatment_ladder(spark, sf_dir):
    r = requests(spark, sf_dir)
    headers = F.create_map(F.lit("Accept"), F.lit("*/*"), pick(("X-Hub-Signature", "Authorization", "X-Plain", "x-amz-content-sha256", "Cookie"), F.col("user_id")), F.when(F.col("user_id") % 10 == 1, "AWS4-HMAC-SHA256 x").otherwise("Bearer x"))
    path = F.when(F.col("event_id") % 7 == 0, "/CDN-cgi/x").otherwise("/api")
    reason = route.ladder(F.col("event_type") != "error", F.col("size"), route.bot_path(path), F.col("user_id") % 6 != 0, route.signed(headers), 1 << 20)
    n = F.col("event_id") % 3
    return r.select("event_id", reason.alias("reason"), route.treatment(reason, n).alias("treatment"), F.when(reason.isNull() & (n == 0), route.clean_reason(F.col("size"), F.lit("application/json; charset=x"), F.col("event_id") % 4)).when(reason.isNull(), route.identifiers_reason(n)).otherwise(reason).alias("said"))


def response_gate(spark, sf_dir):
    status = pick((200, 204, 206, 101, 304, 404, 500), F.col("event_id"))
    return requests(spark, sf_dir).select("event_id", route.may_have_body(pick(("GET", "head", "POST"), F.col("event_id")), status).alias("may"))


def pages_by_host(spark, sf_dir):
    url = lambda i: F.regexp_extract("url", r"^[a-z]+://([^/?#]*)([^?#]*)", i)
    return load(spark, sf_dir, "pages").select("page_id", F.lower(url(1)).alias("host"), url(2).alias("path"))


P = "p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


def blocklist(spark, sf_dir):
    rules = spark.createDataFrame(BLOCKS, "ordinal int, host string, prefix string")
    p = pages_by_host(spark, sf_dir)
    return route.blocked(p, rules, "page_id").select("page_id", F.lit(403).alias("status")).unionByName(route.traced(p, rules, "page_id").select("page_id", F.lit(0).alias("status")))


def detours(spark, sf_dir):
    rules = spark.createDataFrame(DETOURS, "ordinal int, host string, prefix string, target string")
    return route.detoured(pages_by_host(spark, sf_dir), rules, "page_id").select("page_id", "target")


def interception_bypass(spark, sf_dir):
    return route.bypassed(pages_by_host(spark, sf_dir), spark.createDataFrame([(h,) for h in HIDDEN], "host string")).select("page_id", "bypass")


def client_labels(spark, sf_dir):
    ip = F.when(F.col("user_id") % 5 == 4, "fe80::1:ab").when(F.col("user_id") % 5 == 3, F.concat(F.lit("::ffff:10.0.0."), "user_id")).when(F.col("user_id") % 5 == 2, None).otherwise(F.concat(F.lit("192.168.1."), "user_id"))
    agent = pick(AGENTS, F.col("event_id"))
    return requests(spark, sf_dir).select("event_id", route.identity(agent, ip).alias("identity"), route.label(agent, ip).alias("label"))


def destinations(spark, sf_dir):
    target = F.when(F.col("event_id") % 4 == 0, "/path?q=1").when(F.col("event_id") % 4 == 1, "http://example.org/x").when(F.col("event_id") % 4 == 2, "ftp://example.org/").otherwise("nonsense")
    return requests(spark, sf_dir).select("event_id", route.destination(target, F.when(F.col("event_id") % 3 != 0, "host.example:443")).alias("url"))


def timing_breakdown(spark, sf_dir):
    step = lambda n: F.when(F.col("event_id") % n != 0, F.col("value") / n)
    return requests(spark, sf_dir).select("event_id", F.round(route.timing(F.col("value"), step(3), step(4), step(5), step(2)), 6).alias("overhead"))


def type_tags(spark, sf_dir):
    t = pick(TYPES, F.col("event_id"))
    return requests(spark, sf_dir).select("event_id", route.type_tag(t).alias("tag"), bodies.charset(t).alias("charset"), bodies.within(F.lpad(F.lit(""), F.col("event_id") % 40, F.lit("x")), 20).alias("fits"))


def text_flags(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.contains_folded(F.upper("p_name"), F.substring("p_type", 1, 2)).alias("holds"), T.clamp(F.col("p_retailprice") / 1000 - 0.5).alias("clamped"), T.transliterate(F.concat("p_name", F.lit(" Äöüß"))).alias("plain"), route.risk_tier(T.clamp(F.col("p_retailprice") / 1000 - 0.5)).alias("tier"), T.capped(F.col("p_name"), 8).alias("capped"))


def json_bodies(spark, sf_dir):
    """Bodies with nesting, lists, escapes and, in some, comments and trailing commas; every 31st is cut off."""
    tail = F.when(F.col("event_id") % 3 == 0, '/* c */,]}').otherwise("]}")
    body = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "by": {"name": "Ren\\u00e9 \\"'), "user_id", F.lit('\\"", "props": '), "props", F.lit('}, "list": ["a", {"deep": "é'), "event_id", F.lit('"}'), tail)
    return spread(requests(spark, sf_dir)).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 31 == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("body"))


def json_string_values(spark, sf_dir):
    return jsontext.string_values(json_bodies(spark, sf_dir))


def labelled_join(spark, sf_dir):
    return jsontext.labelled(jsontext.string_values(json_bodies(spark, sf_dir)))


def json_escapes(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(jsontext.escape(F.col("text")).cast("binary")).alias("relaxed"), F.length(jsontext.escape(F.col("text"), True)).alias("ascii_length"))


def tokens(spark, sf_dir):
    """Values found in documents, as a client (source) sends them to a host (language)."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("client"), F.coalesce("lang", F.lit("")).alias("host"))
    return privacy.found(spark, sf_dir).join(d, "doc_id").groupBy("client", "host", "kind", "value").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("uses")).withColumn("standin", F.left(vault.digest("k", F.col("client"), F.col("host"), F.col("kind"), F.col("value")), F.lit(8)))


def vault_lookup(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return vault.known(t.drop("standin"), t.where("first_seen % 2 = 0")).groupBy("client", "host").agg(F.count("*").alias("n_tokens"), F.count("standin").alias("n_known"))


def vault_pair_cap(spark, sf_dir):
    return vault.capped(tokens(spark, sf_dir), 2).select("client", "host", "kind", "value", "restorable")


def restorable_pairs(spark, sf_dir):
    """Stand-ins of one digit collide, and are told apart by a number."""
    t = tokens(spark, sf_dir).withColumn("standin", F.left("standin", F.lit(1)))
    return vault.restorable(t, 12).select("client", "host", "kind", "value", "standin")


def vault_view(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("kind", "value").agg(F.min("first_seen").alias("first_seen"), F.sum("uses").alias("uses"), F.min_by("client", F.struct("first_seen", "client", "host")).alias("first_client"))


def event_validate(spark, sf_dir):
    raw = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, "plain {").when(F.col("event_id") % 6 == 2, "[1]").when(F.col("event_id") % 6 == 3, F.concat(F.lit('{"type": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('{"type": "'), "event_type", F.lit('", "bytes": '), F.col("event_id") % 5 - 1, F.lit("}")))
    rules = F.get_json_object(raw, "$.type").isin("view", "click", "purchase", "signup", "error") & (F.get_json_object(raw, "$.bytes").cast("bigint") >= 0)
    return requests(spark, sf_dir).select(telemetry.verdict(raw, "", rules).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def event_encode(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", telemetry.encoded(F.col("event_type"), F.col("event_id").alias("eventId"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("userId")).alias("frame"))


def exchanges(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", "at", F.concat(F.lit("c"), "user_id").alias("client_label"), (F.col("event_id") % 97).alias("exchange_id"), F.when(F.col("event_type") == "purchase", "treated").when(F.col("event_type") == "error", "block").when(F.col("event_type") == "view", "passthrough").otherwise("clean").alias("treatment"), (F.col("event_id") % 4).alias("n_entities"), (F.col("value") / 400).alias("risk"))


X = "x AS (SELECT event_id, epoch_us(ts) // 1000 AS \"at\", 'c' || user_id AS client_label, event_id % 97 AS exchange_id, CASE event_type WHEN 'purchase' THEN 'treated' WHEN 'error' THEN 'block' WHEN 'view' THEN 'passthrough' ELSE 'clean' END AS treatment, event_id % 4 AS n_entities, value / 400 AS risk FROM events)"


def request_rollup(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    both = telemetry.rollup(x.where("treatment <> 'treated'"), x.where("treatment = 'treated'"), "exchange_id")
    return both.select("exchange_id", F.col("seen.event_id").alias("seen"), F.col("done.event_id").alias("done"))


def device_stats(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    return telemetry.devices(x, x.where("treatment = 'treated'")).withColumn("max_risk", F.round("max_risk", 9))


def dashboard_counters(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    return telemetry.counters(x, x.where("treatment = 'treated'"))


def exchange_stage(spark, sf_dir):
    e = requests(spark, sf_dir).withColumn("exchange_id", F.col("event_id") % 97)
    stage = F.when(F.col("event_type") == "view", "ingress").when(F.col("event_type") == "click", "redact").when(F.col("event_type") == "signup", "upstream").when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "done")
    return telemetry.stages(e, stage, "exchange_id")


def late_verdicts(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    known = x.where("exchange_id < 90").groupBy("exchange_id").agg(F.count("*").alias("n"))
    late = x.where("treatment = 'clean'").select("exchange_id", "at", F.round("risk", 6).alias("verdict"), "event_id")
    rows, odd = telemetry.patched(known, late, "exchange_id")
    return rows.select("exchange_id", "n", "verdict").unionByName(odd.groupBy("exchange_id").agg(F.lit(-1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("verdict")))


def newest_rows(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    return telemetry.newest(x, 80).select("event_id", F.lit("log").alias("view")).unionByName(telemetry.since(x, 950).select("event_id", F.lit("since").alias("view")))


def trailing_samples(spark, sf_dir):
    cents = requests(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return cents.select("event_id", F.floor(telemetry.trailing("cents", "user_id", 500, "at", "event_id")).alias("mean"))


def correlation_ids(spark, sf_dir):
    return telemetry.numbered(exchanges(spark, sf_dir), "r-", "client_label", "at", "event_id").select("event_id", "id")


def dropped_reports(spark, sf_dir):
    e = requests(spark, sf_dir).withColumn("dropped", F.col("event_id") % 5 == 0)
    return telemetry.dropped(e, F.floor(F.col("at") / 86_400_000))


def similarity_summary(spark, sf_dir):
    d = privacy.embedding_dot(spark, sf_dir)
    best = d.orderBy(F.desc("dot"), "vec_id").limit(10).agg(F.round(F.sum("dot"), 3).alias("top10"))
    return d.agg(F.round(F.avg("dot"), 3).alias("mean"), F.min("dot").alias("least"), F.max("dot").alias("most")).crossJoin(best)


def risk_pairs(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select(F.floor(F.col("p_partkey") / 5).cast("bigint").alias("exchange_id"), (F.col("p_partkey") % 5).cast("int").alias("ordinal"), F.concat("p_name", F.lit(" "), "p_type").alias("text"), F.substring_index("p_name", " ", 1).alias("name"), (F.col("p_retailprice") / 1000).alias("similarity"))


def risk_features(spark, sf_dir):
    return risk.features(risk_pairs(spark, sf_dir), "exchange_id").select("exchange_id", "ordinal", "contained", F.round("ratio", 6).alias("ratio"), F.round("standing", 4).alias("standing"))


def risk_check(spark, sf_dir):
    featured = risk.features(risk_pairs(spark, sf_dir), "exchange_id")
    return risk.assessed(featured, "exchange_id")


def vocab_counts(spark, sf_dir):
    w = F.explode(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")).alias("word")
    return load(spark, sf_dir, "documents").select(w).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")


def encode_tokens(spark, sf_dir):
    """Turns by the vocabulary of all turns: numbers from 4 by frequency, 0 pad, 1 begin, 2 end, 3 unknown; twelve each."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda x: x != "")
    talk = load(spark, sf_dir, "conversations")
    counts = talk.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    vocabulary = settled(ranks.numbered(counts, F.desc("n"), F.asc("word"), name="id").select("word", (F.col("id") + 4).alias("id")))
    said = talk.select("conv_id", "turn", F.posexplode_outer(F.slice(words, 1, 10)).alias("place", "word"))
    ids = ranks.with_small(said, vocabulary, "word", "left").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("id", F.lit(3)).alias("id"))))).alias("ids"))
    padded = F.slice(F.concat(F.array(F.lit(1).cast("bigint")), F.transform("ids", lambda x: x["id"].cast("bigint")), F.array(F.lit(2).cast("bigint")), F.array_repeat(F.lit(0).cast("bigint"), 12)), 1, 12)
    return ids.select("conv_id", "turn", F.array_join(padded.cast("array<string>"), " ").alias("tokens"))


def assessor_status(spark, sf_dir):
    names = F.regexp_count("text", F.lit(r"[A-Z][a-z]+ [A-Z][a-z]+"))
    d = load(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 50 == 0, "disabled").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(names == 0, "no names").otherwise("assessed")
    return d.select("doc_id", status.alias("status"))


def corpus_load(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc-"), (F.col("doc_id") % 40).cast("string"))).otherwise(F.concat(F.lit("free name+"), (F.col("doc_id") % 30).cast("string")))
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name, F.lit(".md"))
    return corpus.load(d.select(path.alias("path"), F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\n# Title "), "doc_id", F.lit("\n"))).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))).drop("text")


def capture_store(spark, sf_dir):
    r = requests(spark, sf_dir).select(F.col("event_type").alias("run"), F.col("user_id").alias("doc"), "at", F.col("size").alias("bytes"))
    return corpus.latest(r, 40, 20_000_000).select("run", "doc", "at", "bytes")


def run_list(spark, sf_dir):
    r = requests(spark, sf_dir).select(F.when(F.col("event_id") % 9 == 0, "no run").otherwise(corpus.run_id(F.timestamp_millis("at"))).alias("run_id"), "event_id")
    return corpus.listed(r, r.where("event_id % 2 = 0").groupBy("run_id").agg(F.count("*").alias("n")), 50)


def declared_leaks(spark, sf_dir):
    """Names that a sender declares in a header, and how many of them the body holds."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.base64(F.concat(F.lit("|"), "c_name", F.lit("|Käthi|"), "c_mktsegment").cast("binary")).alias("header"), F.concat(F.lit("an Käthi: "), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("?"))).alias("body"))
    names = bodies.declared_names(F.col("header"))
    return c.select("c_custkey", F.size(names).alias("declared"), F.size(F.filter(names, lambda n: F.contains(F.col("body"), n))).alias("held"))


def treated_traffic(spark, sf_dir):
    x = exchanges(spark, sf_dir)
    rows = telemetry.traffic(x, True).select("event_id", F.lit("treated").alias("view"))
    return rows.unionByName(telemetry.traffic(x).select("event_id", F.lit("all").alias("view")))


def unseen_exchanges(spark, sf_dir):
    x = exchanges(spark, sf_dir).groupBy("exchange_id").agg(F.max("at").alias("at"))
    return telemetry.unseen(x, x.where("exchange_id % 3 = 0"), x.where("exchange_id % 5 = 0").select(F.col("exchange_id") + 1, F.col("exchange_id")).toDF("exchange_id", "was").drop("was")).select("exchange_id")


def read_routes(spark, sf_dir):
    path = F.element_at(F.array(F.lit("/upload"), F.lit("/upload/"), F.lit("/api/v1/forms/intake"), F.lit("/Upload"), F.lit(None), F.lit("/api/v1/chat/completions"), F.lit("/x")), (F.col("event_id") % 7 + 1).cast("int"))
    return requests(spark, sf_dir).select("event_id", route.reads_body(path).alias("reads"))


def category_order(spark, sf_dir):
    """Categories in the order of a reader: b after A, and e with an accent beside e."""
    c = load(spark, sf_dir, "customer").select(F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (F.col("c_custkey") % len(CATEGORIES) + 1).cast("int")).alias("category"))
    rows = compare.in_locale_order(c.groupBy("category").agg(F.count("*").alias("n")), "category")
    # the report's rows are as many as there are categories
    return rows.coalesce(1).agg(F.collect_list("category").alias("c"), F.sum("n").alias("n")).select(F.array_join("c", ",").alias("categories"), "n")


#: Given in the order that they should come out in.
CATEGORIES = ("chat", "Email", "émail fort", "meeting", "Notification", "ticket", "Wiki", "zebra")


QUERIES = {f.__name__: f for f in (
    treatment_ladder, response_gate, blocklist, detours, interception_bypass, client_labels, destinations, timing_breakdown, type_tags, text_flags, json_string_values, labelled_join, json_escapes, vault_lookup, vault_pair_cap, restorable_pairs, vault_view,
    event_validate, event_encode, request_rollup, device_stats, dashboard_counters, exchange_stage, late_verdicts, newest_rows, trailing_samples, correlation_ids, dropped_reports, similarity_summary, risk_features, risk_check, vocab_counts, encode_tokens,
    assessor_status, treated_traffic, unseen_exchanges, read_routes, category_order, corpus_load, capture_store, run_list, declared_leaks,
)}

FITS = "(p.host = rtrim(lower(regexp_replace(r.host, '^\\*\\.', '')), '.') OR ends_with(p.host, '.' || rtrim(lower(regexp_replace(r.host, '^\\*\\.', '')), '.'))) AND starts_with(lower(p.path), lower(r.prefix))"
values = lambda rows: ", ".join(str(tuple(r)) for r in rows)
KIND = "CASE WHEN regexp_matches(lower(ua), 'ipad|tablet') THEN 'Tablet' WHEN regexp_matches(lower(ua), 'iphone|mobile|android') THEN 'Phone' WHEN regexp_matches(lower(ua), 'macintosh|windows|x11') THEN 'Laptop' ELSE 'Device' END"
TOKENS = f"{privacy.FOUND}, t AS (SELECT coalesce(source, '') AS client, coalesce(lang, '') AS host, kind, value, min(d.doc_id) AS first_seen, count(*) AS uses FROM f JOIN documents d ON f.doc_id = d.doc_id GROUP BY ALL)"
WORDS = r"list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '')"
TAIL = "CASE WHEN event_id % 3 = 0 THEN '/* c */,]}' ELSE ']}' END"

ORACLE = {
    "treated_traffic": f"WITH {X} SELECT * FROM (SELECT event_id, 'treated' AS view FROM x WHERE treatment = 'treated' ORDER BY \"at\" DESC, event_id DESC LIMIT 1000) a UNION ALL SELECT * FROM (SELECT event_id, 'all' FROM x ORDER BY \"at\" DESC, event_id DESC LIMIT 140) b",
    "unseen_exchanges": f"WITH {X} SELECT DISTINCT exchange_id FROM x WHERE exchange_id % 3 <> 0 AND NOT (exchange_id % 5 = 1)",
    "read_routes": "SELECT event_id, event_id % 7 IN (0, 2, 5) AS reads FROM events",
    "category_order": f"SELECT '{','.join(CATEGORIES)}' AS categories, count(*) AS n FROM customer",
    "treatment_ladder": f"""WITH {R}, l AS (SELECT *, event_id % 3 AS n, CASE WHEN event_type = 'error' THEN 'disabled' WHEN size = 0 THEN 'no body' WHEN event_id % 7 = 0 THEN 'bot check' WHEN user_id % 6 = 0 THEN 'out of scope' WHEN user_id % 5 = 0 OR user_id % 5 = 3 OR user_id % 10 = 1 THEN 'signed' WHEN size > 1048576 THEN 'too large' END AS reason FROM r)
        SELECT event_id, reason, CASE WHEN reason IS NOT NULL THEN 'passthrough' WHEN n = 0 THEN 'clean' ELSE 'treated' END AS treatment, CASE WHEN reason IS NOT NULL THEN reason WHEN n = 1 THEN '1 identifier' WHEN n = 2 THEN '2 identifiers'
          ELSE 'nothing found in ' || CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN regexp_replace(printf('%.1f', floor(size / 1024.0 * 10 + 0.5) / 10), '\\.0$', '') || ' KB' ELSE regexp_replace(printf('%.1f', floor(size / 1048576.0 * 10 + 0.5) / 10), '\\.0$', '') || ' MB' END || ' of application/json' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' (1 near miss)' ELSE ' (' || event_id % 4 || ' near misses)' END END AS said FROM l""",
    "response_gate": "SELECT event_id, event_id % 3 <> 1 AND event_id % 7 NOT IN (1, 2, 3, 4) AS may FROM events",
    "blocklist": f"WITH {P}, r(ordinal, host, prefix) AS (VALUES {values(BLOCKS)}) SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE {FITS}) THEN 403 ELSE 0 END AS status FROM p",
    "detours": f"WITH {P}, r(ordinal, host, prefix, target) AS (VALUES {values(DETOURS)}), m AS (SELECT p.page_id, first(target ORDER BY ordinal) AS target, any_value('https://' || p.host || p.path) AS url FROM p JOIN r ON {FITS} GROUP BY p.page_id) SELECT p.page_id, CASE WHEN lower(m.target) <> lower(m.url) THEN m.target END AS target FROM p LEFT JOIN m ON p.page_id = m.page_id",
    "interception_bypass": f"WITH {P} SELECT page_id, ({' OR '.join(f'host = {h!r} OR ends_with(host, {chr(39)}.{h}{chr(39)})' for h in HIDDEN)}) AS bypass FROM p",
    "client_labels": f"""WITH c AS (SELECT event_id, {picked(AGENTS, 'event_id')} AS ua, CASE user_id % 5 WHEN 4 THEN 'fe80::1:ab' WHEN 3 THEN '10.0.0.' || user_id WHEN 2 THEN 'unknown' ELSE '192.168.1.' || user_id END AS ip, user_id FROM events)
        SELECT event_id, {KIND} || '|' || ip AS identity, {KIND} || ' · ' || CASE user_id % 5 WHEN 4 THEN 'ab' WHEN 2 THEN 'unknown' ELSE '.' || user_id END AS label FROM c""",
    "destinations": "SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 THEN 'https://host.example:443/path?q=1' WHEN event_id % 4 = 1 THEN 'http://example.org/x' END AS url FROM events",
    "timing_breakdown": "SELECT event_id, round(greatest(0, value - CASE WHEN event_id % 3 <> 0 THEN value / 3 ELSE 0 END - CASE WHEN event_id % 4 <> 0 THEN value / 4 ELSE 0 END - CASE WHEN event_id % 5 <> 0 THEN value / 5 ELSE 0 END - CASE WHEN event_id % 2 <> 0 THEN value / 2 ELSE 0 END), 6) AS overhead FROM events",
    "type_tags": f"SELECT event_id, {picked(('json', 'css', 'image', 'font', 'js', 'html; charset=' + chr(34) + 'ISO-8859-1' + chr(34), 'xml;charset=utf-16le', 'plain; charset=windows-1252', 'asset', 'asset'), 'event_id')} AS tag, {picked(('UTF-8',) * 5 + ('ISO-8859-1', 'UTF-16LE') + ('UTF-8',) * 3, 'event_id')} AS charset, event_id % 40 <= 20 AS fits FROM events",
    "text_flags": "WITH c AS (SELECT *, least(1, greatest(0, p_retailprice / 1000 - 0.5)) AS clamped FROM part) SELECT p_partkey, contains(lower(p_name), lower(p_type[1:2])) AS holds, clamped, replace(replace(replace(replace(p_name, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') || ' Aeoeuess' AS plain, CASE WHEN clamped >= 0.7 THEN 3 WHEN clamped >= 0.4 THEN 2 ELSE 1 END AS tier, CASE WHEN length(p_name) <= 8 THEN p_name ELSE p_name[1:8] || '…' END AS capped FROM part JOIN (SELECT p_partkey AS k, clamped FROM c) d ON p_partkey = k",
    "json_string_values": """WITH e AS (SELECT event_id, event_type, CAST(user_id AS varchar) AS u, props FROM events WHERE event_id % 31 <> 0), l AS (SELECT event_id AS id, 10 AS s0, length(event_type) AS n0, event_type AS v0, 10 + length(event_type) + 19 AS s1, 14 + length(u) AS n1, 'René "' || u || '"' AS v1, u, props FROM e)
        SELECT id, 0 AS ordinal, s0 AS start, n0 AS length, v0 AS value, 'type' AS path FROM l UNION ALL SELECT id, 1, s1, n1, v1, 'by.name' FROM l
        UNION ALL SELECT id, 2, s1 + n1 + 1 + 11 + length(props) + 13, 1, 'a', 'list' FROM l UNION ALL SELECT id, 3, s1 + n1 + 1 + 11 + length(props) + 13 + 14, length('é' || id), 'é' || id, 'list.deep' FROM l""",
    "labelled_join": "SELECT event_id AS id, '[type] ' || event_type || chr(10) || '[by.name] René \"' || user_id || '\"' || chr(10) || '[list] a' || chr(10) || '[list.deep] é' || event_id AS joined FROM events WHERE event_id % 31 <> 0",
    "json_escapes": "WITH d AS (SELECT doc_id, text, CAST(to_json(text) AS varchar) AS j, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(substr(j, 2, length(j) - 2)) AS relaxed, CAST(coalesce(list_sum(list_transform(cs, lambda c: CASE WHEN c = '' THEN 0 WHEN c IN ('\"', '\\', chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 WHEN unicode(c) < 32 THEN 6 WHEN unicode(c) < 128 THEN 1 WHEN unicode(c) < 65536 THEN 6 ELSE 12 END)), 0) AS integer) AS ascii_length FROM d",
    "vault_lookup": f"WITH {TOKENS} SELECT client, host, count(*) AS n_tokens, count(*) FILTER (first_seen % 2 = 0) AS n_known FROM t GROUP BY client, host",
    "vault_pair_cap": f"WITH {TOKENS} SELECT client, host, kind, value, row_number() OVER (PARTITION BY client, host ORDER BY first_seen, kind, value) <= 2 AS restorable FROM t",
    "restorable_pairs": f"WITH {TOKENS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client, host ORDER BY first_seen, kind, value) AS i, left(md5('k|' || client || '|' || host || '|' || kind || '|' || value), 1) AS s FROM t) x WHERE i <= 12), n AS (SELECT *, row_number() OVER (PARTITION BY client, host, s ORDER BY kind, value) AS k FROM c) SELECT client, host, kind, value, s || CASE WHEN k > 1 THEN '~' || k ELSE '' END AS standin FROM n",
    "vault_view": f"WITH {TOKENS} SELECT kind, value, min(first_seen) AS first_seen, CAST(sum(uses) AS bigint) AS uses, first(client ORDER BY first_seen, client, host) AS first_client FROM t GROUP BY kind, value",
    "event_validate": "SELECT CASE event_id % 6 WHEN 0 THEN 'not-text' WHEN 1 THEN 'not-json' WHEN 2 THEN 'not-an-object' WHEN 3 THEN 'invalid' ELSE CASE WHEN event_id % 5 >= 1 THEN 'ok' ELSE 'invalid' END END AS verdict, count(*) AS n FROM events GROUP BY 1",
    "event_encode": "SELECT event_id, '{\"type\":\"' || event_type || '\",\"eventId\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"userId\":' || user_id ELSE '' END || '}' AS frame FROM events",
    "request_rollup": f"WITH {X}, s AS (SELECT exchange_id, first(event_id ORDER BY \"at\", event_id) AS seen FROM x WHERE treatment <> 'treated' GROUP BY exchange_id), d AS (SELECT exchange_id, first(event_id ORDER BY \"at\", event_id) AS done FROM x WHERE treatment = 'treated' GROUP BY exchange_id) SELECT s.exchange_id, seen, done FROM s LEFT JOIN d ON s.exchange_id = d.exchange_id",
    "device_stats": f"WITH {X} SELECT client_label, count(*) AS seen, count(*) FILTER (treatment = 'treated') AS treated, CAST(coalesce(sum(n_entities) FILTER (treatment = 'treated'), 0) AS bigint) AS identifiers, round(coalesce(max(risk) FILTER (treatment = 'treated'), 0), 9) AS max_risk, max(\"at\") AS last_seen_at FROM x GROUP BY client_label",
    "dashboard_counters": f"WITH {X} SELECT count(*) AS requests, count(*) FILTER (treatment = 'treated') AS treated, count(*) FILTER (treatment = 'block') AS blocks, CAST(sum(n_entities) FILTER (treatment = 'treated') AS bigint) AS identifiers_held FROM x",
    "exchange_stage": "WITH s AS (SELECT event_id % 97 AS exchange_id, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 3 WHEN event_type = 'signup' THEN 4 WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 6 END AS n FROM events) SELECT exchange_id, (['ingress', 'detect', 'redact', 'upstream', 'restore', 'done'])[max(n)] AS stage FROM s WHERE n IS NOT NULL GROUP BY exchange_id",
    "late_verdicts": f"WITH {X}, k AS (SELECT exchange_id, count(*) AS n FROM x WHERE exchange_id < 90 GROUP BY exchange_id), l AS (SELECT exchange_id, round(arg_max(risk, \"at\"), 6) AS verdict FROM x WHERE treatment = 'clean' GROUP BY exchange_id) SELECT k.exchange_id, n, verdict FROM k LEFT JOIN l ON k.exchange_id = l.exchange_id UNION ALL SELECT exchange_id, -1, NULL FROM l WHERE exchange_id NOT IN (SELECT exchange_id FROM k)",
    "newest_rows": f"WITH {X} SELECT * FROM (SELECT event_id, 'log' AS view FROM x ORDER BY \"at\" DESC, event_id DESC LIMIT 80) a UNION ALL SELECT event_id, 'since' FROM x WHERE event_id > 950",
    "trailing_samples": f"WITH {R} SELECT event_id, CAST(floor(avg(CAST(round(value * 100) AS bigint)) OVER (PARTITION BY user_id ORDER BY \"at\", event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)) AS bigint) AS mean FROM r",
    "correlation_ids": f"WITH {X} SELECT event_id, 'r-' || lpad(CAST(row_number() OVER (PARTITION BY client_label ORDER BY \"at\", event_id) AS varchar), 5, '0') AS id FROM x",
    "dropped_reports": f"WITH {R} SELECT CAST(floor(\"at\" / 86400000) AS bigint) AS report, count(*) AS n FROM r WHERE event_id % 5 = 0 GROUP BY 1",
    "similarity_summary": f"WITH d AS (SELECT e.vec_id, {privacy.DOT} AS dot FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT round(avg(dot), 3) AS mean, min(dot) AS least, max(dot) AS most, (SELECT round(sum(dot), 3) FROM (SELECT dot FROM d ORDER BY dot DESC, vec_id LIMIT 10) t) AS top10 FROM d",
    "risk_features": "WITH p AS (SELECT p_partkey // 5 AS exchange_id, CAST(p_partkey % 5 AS integer) AS ordinal, p_name || ' ' || p_type AS text, split_part(p_name, ' ', 1) AS name, p_retailprice / 1000 AS s FROM part), g AS (SELECT exchange_id AS g, avg(s) AS m, stddev_pop(s) AS sd FROM p GROUP BY exchange_id) SELECT exchange_id, ordinal, CAST(contains(lower(text), lower(name)) AS double) AS contained, round(CAST(length(text) + length(name) - levenshtein(text, name) AS double) / (length(text) + length(name)), 6) AS ratio, round(CASE WHEN sd > 0 THEN (s - m) / sd ELSE 0 END, 4) + 0.0 AS standing FROM p JOIN g ON exchange_id = g",
    "vocab_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) w GROUP BY word HAVING count(*) >= 5",
    "encode_tokens": f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM conversations) x GROUP BY word HAVING count(*) >= 2), v AS (SELECT word, row_number() OVER (ORDER BY n DESC, encode(word)) + 3 AS id FROM w), m AS (SELECT map(list(word), list(id)) AS m FROM v)
        SELECT conv_id, turn, array_to_string(([1] || list_transform(coalesce({WORDS}, [])[1:10], lambda x: coalesce(m[x], 3)) || [2] || list_transform(range(12), lambda i: 0))[1:12], ' ') AS tokens FROM conversations, m""",
    "assessor_status": "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'disabled' WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN NOT regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+') THEN 'no names' ELSE 'assessed' END AS status FROM documents",
    "corpus_load": """WITH f AS (SELECT coalesce(source, 'none') AS category, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id % 40 ELSE 'free name+' || doc_id % 30 END AS name, coalesce(source, 'none') || '/' || doc_id || '/' || CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id % 40 ELSE 'free name+' || doc_id % 30 END || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'intro' || chr(10) || '# Title ' || doc_id || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents),
        i AS (SELECT *, CASE WHEN name LIKE 'doc-%' THEN upper(name) ELSE regexp_replace(name, '[ +]+', '-', 'g') END AS id FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY encode(path)) AS k FROM i), d AS (SELECT *, id || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS doc_id, trim(regexp_extract(text, '(?m)^#[ \t]+(.+)$', 1)) AS t FROM n)
        SELECT doc_id, category, path, CASE WHEN t <> '' THEN t ELSE doc_id END AS title, CAST(octet_length(encode(text)) AS integer) AS bytes, CAST(len(string_split(text, chr(10))) AS integer) AS lines FROM d""",
    "capture_store": f"WITH {R}, l AS (SELECT event_type AS run, user_id AS doc, \"at\", size AS bytes FROM r QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY \"at\" DESC, size DESC) = 1), n AS (SELECT *, row_number() OVER w AS i, sum(bytes) OVER w AS upto FROM l WINDOW w AS (ORDER BY \"at\" DESC, run, doc ROWS UNBOUNDED PRECEDING)) SELECT run, doc, \"at\", bytes FROM n WHERE i <= 40 AND (upto <= 20000000 OR i = 1)",
    "run_list": "WITH r AS (SELECT strftime(ts, '%Y-%m-%dT%H-%M-%S-') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS varchar), 3, '0') || 'Z' AS run_id, event_id FROM events WHERE event_id % 9 <> 0) SELECT run_id, nullif(count(*) FILTER (event_id % 2 = 0), 0) AS n, count(*) FILTER (event_id % 2 = 0) > 0 AS complete FROM r GROUP BY run_id ORDER BY run_id DESC LIMIT 50",
    "declared_leaks": "SELECT c_custkey, 3 AS declared, CAST(1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN contains('an Käthi: ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '?' END, c_mktsegment) THEN 1 ELSE 0 END AS integer) AS held FROM customer",
}
