"""Queries of exact ranks, overlapping spans, seeded draws, and exchanges folded from their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.functions import detect
from veilwork.operators import exchange, intervals, permuted, ranks
from veilwork.plans import privacy
from veilwork.session import load
from veilwork.sources import fixtures

NUMBERS = r"\b[0-9]+\b"


def interval_overlap(spark, sf_dir):
    """Numbers of the documents that lie in what the recognisers find."""
    docs = load(spark, sf_dir, "documents").where("text is not null")
    numbers = docs.select("doc_id", F.explode(detect.matches("text", NUMBERS)).alias("m")).select("doc_id", "m.start", "m.end", "m.value")
    pairs = intervals.overlapping(detect.findings(docs), numbers, "doc_id", width=64)
    return pairs.groupBy("doc_id", "kind", F.col("start").alias("start_"), "value").agg(F.count("*").alias("n"), F.min("b_start").alias("first_number"))


def latency_percentiles(spark, sf_dir):
    lanes = load(spark, sf_dir, "events").select(F.struct("event_type", (F.col("user_id") % 8).alias("lane")).alias("group"), "value")
    found = ranks.order_statistics(lanes, "group", "value", {"p50": ranks.nearest_rank(0.5), "p95": ranks.nearest_rank(0.95), "most": F.col("n") - 1})
    return found.select("group.event_type", "group.lane", "p50", "p95", "most")


def upper_median(spark, sf_dir):
    return ranks.order_statistics(load(spark, sf_dir, "events"), "user_id", "value", {"median_ms": F.floor(F.col("n") / 2)}).select("user_id", "median_ms")


def latency_ranks(spark, sf_dir):
    """The place of each event among all, by value."""
    return ranks.numbered(load(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id").select("event_id", F.col("n").alias("place"))


def seeded_scenarios(spark, sf_dir):
    """Two draws an order decide its scenario: numbers 2 n + 1 and 2 n + 2 of the sequence of seed 7."""
    n = F.col("o_orderkey") * 2
    one, two = fixtures.seeded(7, n + 1), fixtures.seeded(7, n + 2)
    rows = load(spark, sf_dir, "orders").select("o_orderkey", fixtures.scenario(one, two, 0.3).alias("scenario"), F.round(one, 9).alias("draw"))
    return rows


REPORTS = ("observed", "detection", "assess", "redaction", "assess", "delivered", "completed", "assessed")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of exchanges, some not observed, some not completed; every tenth comes twice."""
    e = load(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(r) for r in REPORTS]), (F.col("event_id") % 8 + 1).cast("int"))
    x = F.floor(F.col("event_id") / 8)
    kind = F.when((x % 11 == 0) & (kind == "observed"), "detection").when((x % 5 == 0) & (kind == "completed"), "responded").otherwise(kind)
    rows = e.select(x.alias("exchange_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), kind.alias("type"), F.round("value", 2).alias("value"))
    return rows.unionByName(rows.where("event_id % 10 = 0"))


def exchange_machine(spark, sf_dir):
    rows = exchange.folded(reports(spark, sf_dir))
    return rows.withColumns({"opened_at": F.unix_micros("opened_at"), "done_at": F.unix_micros("done_at")})


def keyed_standins(spark, sf_dir):
    """Another valid number for each sure number of the records."""
    found = detect.findings(fixtures.records(spark, sf_dir), list(permuted.RULES)).where(F.col("score") >= detect.THRESHOLD)
    return found.select("kind", "value").distinct().withColumn("standin", permuted.standin("kind", "value", privacy.KEY))


QUERIES = {f.__name__: f for f in (interval_overlap, latency_percentiles, upper_median, latency_ranks, seeded_scenarios, exchange_machine, keyed_standins)}

#: The generator in 128-bit numbers.
DRAW = """(SELECT xor(c, c >> 14) / 4294967296.0 FROM (SELECT CAST(xor(b, CAST((b + (CAST(xor(b, b >> 7) AS hugeint) * CAST(b | 61 AS hugeint)) % 4294967296) % 4294967296 AS bigint)) AS bigint) AS c
    FROM (SELECT CAST((CAST(xor(a, a >> 15) AS hugeint) * CAST(a | 1 AS hugeint)) % 4294967296 AS bigint) AS b FROM (SELECT CAST((7 + CAST({n} AS hugeint) * 1831565813) % 4294967296 AS bigint) AS a) q1) q2) q3)"""


def scenario_sql(personal: bool) -> str:
    chosen, upto, out = [(n, w) for n, w, p in fixtures.SCENARIOS if p == personal], 0, "CASE"
    for name, weight in chosen:
        upto += weight
        out += f" WHEN two * {sum(w for _, w in chosen)} < {upto} THEN '{name}'"
    return out + " END"


NUMBERED = rf"""n AS (SELECT doc_id, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS integer) AS s, length(ms[i]) AS size
  FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{NUMBERS}') AS ms, string_split_regex(text, '{NUMBERS}') AS gaps FROM documents WHERE text IS NOT NULL) x WHERE len(ms) > 0) y)"""
STAGE = "CASE type WHEN 'observed' THEN 1 WHEN 'detection' THEN 2 WHEN 'redaction' THEN 3 WHEN 'responded' THEN 4 WHEN 'delivered' THEN 5 WHEN 'completed' THEN 6 END"

HEADS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r.head}" for k, r in permuted.RULES.items()) + " END"
TAILS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r.tail}" for k, r in permuted.RULES.items()) + " END"
BEFORE = privacy.DIGITS.replace("{v}", "d")
CHECKS = f"""CASE kind WHEN 'CREDIT_CARD_NUMBER' THEN CAST((10 - list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN 2 * CAST(substr(reverse(d), CAST(j AS integer), 1) AS integer) % 10 + 2 * CAST(substr(reverse(d), CAST(j AS integer), 1) AS integer) // 10 ELSE CAST(substr(reverse(d), CAST(j AS integer), 1) AS integer) END)) % 10) % 10 AS varchar)
  WHEN 'AHV' THEN CAST({privacy.EAN.format(x='d')} AS varchar) WHEN 'PL_PESEL' THEN CAST((10 - {privacy.weighed([1, 3, 7, 9, 1, 3, 7, 9, 1, 3], 'd')} % 10) % 10 AS varchar) WHEN 'AU_COMPANY_NUMBER' THEN CAST((10 - {privacy.weighed([*range(8, 0, -1)], 'd')} % 10) % 10 AS varchar) ELSE '' END"""
#: The permutation round by round, a recursion; then digits are put back one by one.
PERMUTED = f"""RECURSIVE records AS MATERIALIZED ({fixtures.records_sql('customer', 'varchar')}), {privacy.found_sql('records')},
w AS (SELECT DISTINCT kind, value FROM f WHERE score >= 0.6 AND kind IN ({', '.join(privacy.quoted(k) for k in permuted.RULES)})),
p AS (SELECT kind, value, digits, digits[{HEADS} + 1:length(digits) - {TAILS}] AS free FROM (SELECT kind, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM w) x),
r AS (SELECT kind, value, digits, length(free) // 2 AS n, length(free) - length(free) // 2 AS m, 0 AS i, CAST(left(free, length(free) // 2) AS bigint) AS l, CAST(right(free, length(free) - length(free) // 2) AS bigint) AS r FROM p
  UNION ALL SELECT kind, value, digits, n, m, i + 1, l2, (r + CAST('0x' || left(md5('{privacy.KEY}|' || kind || '|' || m || 'r' || (i + 1) || '|' || l2), 12) AS bigint)) % CAST(pow(10, m) AS bigint)
  FROM (SELECT *, (l + CAST('0x' || left(md5('{privacy.KEY}|' || kind || '|' || n || 'l' || (i + 1) || '|' || r), 12) AS bigint)) % CAST(pow(10, n) AS bigint) AS l2 FROM r WHERE i < {permuted.ROUNDS}) y),
d AS (SELECT kind, value, left(digits, {HEADS}) || lpad(CAST(l AS varchar), CAST(n AS integer), '0') || lpad(CAST(r AS varchar), CAST(m AS integer), '0') AS d FROM r WHERE i = {permuted.ROUNDS})"""

ORACLE = {
    "keyed_standins": f"WITH {PERMUTED}, e AS (SELECT kind, value, d || {CHECKS} AS e FROM d) SELECT kind, value, array_to_string(list_transform(range(1, length(value) + 1), lambda k: CASE WHEN value[k] BETWEEN '0' AND '9' THEN e[length(regexp_replace(value[1:k], '[^0-9]', '', 'g'))] ELSE value[k] END), '') AS standin FROM e",
    "interval_overlap": f"WITH {privacy.FOUND}, {NUMBERED} SELECT f.doc_id, kind, start_, value, count(*) AS n, min(s) AS first_number FROM f JOIN n ON f.doc_id = n.doc_id AND start_ < s + size AND s < start_ + length(value) GROUP BY ALL",
    "latency_percentiles": "SELECT event_type, user_id % 8 AS lane, list_sort(list(value))[least(count(*) - 1, CAST(floor(0.5 * count(*)) AS bigint)) + 1] AS p50, list_sort(list(value))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS bigint)) + 1] AS p95, max(value) AS most FROM events GROUP BY 1, 2",
    "upper_median": "SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS median_ms FROM events GROUP BY user_id",
    "latency_ranks": "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events",
    "seeded_scenarios": f"SELECT o_orderkey, CASE WHEN one < 0.3 THEN {scenario_sql(True)} ELSE {scenario_sql(False)} END AS scenario, round(one, 9) AS draw FROM (SELECT o_orderkey, {DRAW.replace('{n}', '(o_orderkey * 2 + 1)')} AS one, {DRAW.replace('{n}', '(o_orderkey * 2 + 2)')} AS two FROM orders) d",
    "exchange_machine": f"""WITH r AS (SELECT event_id // 8 AS exchange_id, event_id, epoch_us(ts) AS "at", CASE WHEN event_id // 8 % 11 = 0 AND event_id % 8 = 0 THEN 'detection' WHEN event_id // 8 % 5 = 0 AND event_id % 8 = 6 THEN 'responded' ELSE ({list(REPORTS)})[event_id % 8 + 1] END AS type, round(value, 2) AS value FROM events),
        s AS (SELECT *, row_number() OVER (PARTITION BY exchange_id ORDER BY "at", event_id) AS i FROM r), o AS (SELECT exchange_id, min(i) AS o FROM s WHERE type = 'observed' GROUP BY exchange_id),
        d AS (SELECT s.exchange_id, min(i) AS d FROM s JOIN o ON s.exchange_id = o.exchange_id WHERE type = 'completed' AND i > o GROUP BY s.exchange_id),
        c AS (SELECT s.*, o, d, i = o OR (i > o AND type <> 'observed' AND (d IS NULL OR i <= d)) OR (type = 'assessed' AND i > o) AS counts FROM s JOIN o ON s.exchange_id = o.exchange_id LEFT JOIN d ON s.exchange_id = d.exchange_id),
        b AS (SELECT exchange_id, count(*) AS busy FROM (SELECT exchange_id, type, lag(type) OVER (PARTITION BY exchange_id ORDER BY i) AS before FROM c WHERE counts AND type IN ('assess', 'assessed')) x WHERE type = 'assess' AND before = 'assess' GROUP BY exchange_id)
        SELECT c.exchange_id, min("at") FILTER (i = o) AS opened_at, min("at") FILTER (i = d) AS done_at, (['ingress', 'detect', 'redact', 'upstream', 'restore', 'done'])[max({STAGE}) FILTER (counts)] AS stage, count(*) FILTER (counts) AS reports, count(*) FILTER (NOT counts) AS ignored,
          coalesce(max(value) FILTER (counts AND type = 'detection'), 0) AS found, coalesce(max(value) FILTER (counts AND type = 'delivered'), 0) AS restored, arg_max(value, i) FILTER (counts AND type = 'assessed') AS verdict, coalesce(any_value(busy), 0) AS busy
        FROM c LEFT JOIN b ON c.exchange_id = b.exchange_id GROUP BY c.exchange_id""",
}
