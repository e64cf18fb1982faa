"""Queries of the evaluation: a corpus of tickets, its gazetteer and ground truth, a redaction, and how well it did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.operators import compare, gazetteer, spans, truth
from veilwork.session import settled
from veilwork.sources import fixtures

# What the tickets' policy keeps
KEEP = ("rechnung@natron.io", "no-reply@ticketsystem.example", "+41 31 528 00 00", "Güterstrasse 24, 3008 Bern")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(fixtures.tickets(spark, sf_dir))


def entities(docs: DataFrame) -> DataFrame:
    return truth.entities(docs, keep=KEEP)


def template_tickets(spark, sf_dir):
    return corpus(spark, sf_dir)


def vouched_names(spark, sf_dir):
    return gazetteer.vouched(corpus(spark, sf_dir))


def gazetteer_people(spark, sf_dir):
    return gazetteer.people(corpus(spark, sf_dir))


def corroborated_names(spark, sf_dir):
    return gazetteer.corroborated(corpus(spark, sf_dir))


def org_suffix_antijoin(spark, sf_dir):
    return gazetteer.organisations(corpus(spark, sf_dir)).withColumnRenamed("name", "org")


def names_except(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return gazetteer.weak_names(gazetteer.people(docs), gazetteer.organisations(docs))


def gazetteer_towns(spark, sf_dir):
    return gazetteer.towns(corpus(spark, sf_dir)).select("name", F.length("name").alias("size")).orderBy(F.desc("size"), "name")


def candidate_union(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return truth.candidates(docs, gazetteer.build(docs).literals()).groupBy("kind", "tier").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


def resolve_overlaps(spark, sf_dir):
    return entities(corpus(spark, sf_dir)).select("doc_id", "index", "kind", "value", F.col("start").alias("start_"), F.col("end").alias("end_"), "tier", "policy", "line")


def truth_totals(spark, sf_dir):
    return truth.totals(entities(corpus(spark, sf_dir)))


def override_problems(spark, sf_dir):
    """A correction for every tenth ticket: its first ten characters, or what is not there any more, or no ticket at all."""
    docs = corpus(spark, sf_dir)
    given = docs.where("doc_id % 10 = 0").select((F.col("doc_id") * F.when(F.col("doc_id") % 30 == 0, -1).otherwise(1)).alias("doc_id"), F.lit("PERSON").alias("kind"), F.substring("text", 1, 10).alias("value"), F.expr("cast(doc_id % 20 as int)").alias("start"), F.expr("cast(doc_id % 20 + 10 as int)").alias("end"), F.lit("strong").alias("tier"), F.lit("redact").alias("policy"))
    checked = settled(truth.checked_overrides(docs, given))
    kept = truth.corrected(docs, checked, keep=KEEP).groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    return checked.select("doc_id", F.coalesce(F.regexp_extract("problem", "(no document|is not at)", 1), F.lit("")).alias("problem")).join(kept, "doc_id", "left").select("doc_id", "problem", F.coalesce("n_entities", F.lit(0)).cast("bigint").alias("n_entities"))


def treated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, sent, received, returned) and truth: a redaction that leaks, half hides, damages and loses some."""
    docs = corpus(spark, sf_dir)
    found = settled(entities(docs))
    turn = (F.col("doc_id") + F.col("start")) % 4
    hide = F.when(F.col("policy") == "redact", turn != 0).when(F.col("policy") == "keep", turn == 2).otherwise(turn == 3)
    token = F.concat(F.lit("x"), F.left(F.md5(F.col("value").cast("binary")), F.lit(6)))
    half = (F.col("kind") == "PERSON") & (F.col("tier") == "strong") & (turn == 1)
    shown = F.when(half, F.concat(token, F.lit(" "), F.substring_index("value", " ", -1))).otherwise(token)
    standins = found.where(hide).withColumn("standin", shown).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "standin"))).alias("s"))
    rows = docs.join(standins, "doc_id", "left").withColumn("out", F.when(F.col("s").isNull(), F.col("text")).otherwise(spans.splice("text", "s")))
    return rows.select("doc_id", F.col("text").alias("sent"), F.when(F.col("doc_id") % 13 != 0, F.col("out")).alias("received"), F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 5 == 0, F.col("out")).otherwise(F.col("text")).alias("returned")), found


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, findings, and the substitutions with their verdicts."""
    docs, found = treated(spark, sf_dir)
    docs = settled(docs)
    out = compare.substitutions(docs, "sent", "received")
    out = settled(out)
    return docs, compare.findings(docs, found, out, compare.substitutions(docs, "sent", "returned")), compare.verdicts(out, found)


def three_way_compare(spark, sf_dir):
    return analysed(spark, sf_dir)[1].select("doc_id", "index", "kind", "outcome", "restoration")


def surviving_fragments(spark, sf_dir):
    found = analysed(spark, sf_dir)[1].where("size(survived) > 0")
    return found.select("doc_id", "index", F.array_join("survived", "|").alias("survived"), "covered")


def classify_substitutions(spark, sf_dir):
    return analysed(spark, sf_dir)[2].groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))


def verdict_counts(spark, sf_dir):
    return compare.verdict_counts(analysed(spark, sf_dir)[2])


def doc_scorecard(spark, sf_dir):
    docs, found, _ = analysed(spark, sf_dir)
    return compare.doc_scores(docs, found)


def kind_scorecard(spark, sf_dir):
    return compare.kind_scores(analysed(spark, sf_dir)[1])


def category_scorecard(spark, sf_dir):
    """Tickets by template."""
    docs, found, _ = analysed(spark, sf_dir)
    scores = compare.doc_scores(docs, found).groupBy(F.concat(F.lit("template "), F.col("doc_id") % 7).alias("category"))
    return scores.agg(F.count("*").alias("n_docs"), F.sum("redactable").alias("redactable"), F.sum("leaked").alias("leaked"), F.sum("damaged").alias("damaged"))


def headline_metrics(spark, sf_dir):
    docs, found, subs = analysed(spark, sf_dir)
    row = compare.headline(compare.doc_scores(docs, found), compare.verdict_counts(subs))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


def ci_gate(spark, sf_dir):
    docs, found, _ = analysed(spark, sf_dir)
    failed = docs.select("doc_id", (F.col("received").isNull() | F.col("returned").isNull()).alias("failed"))
    return compare.gate(compare.doc_scores(docs, found).join(failed, "doc_id"))


def applied_confidence(spark, sf_dir):
    """Mean score and number of the applied spans of a kind; a shape is sure, a name from the gazetteer less so."""
    score = F.when(F.col("tier") == "weak", 0.65).when(F.col("kind").isin("PERSON", "ORG", "LOCATION"), 0.85).otherwise(1.0)
    return entities(corpus(spark, sf_dir)).withColumn("score", score).groupBy("kind").agg(F.round(F.avg("score"), 9).alias("confidence"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    template_tickets, vouched_names, gazetteer_people, corroborated_names, org_suffix_antijoin, names_except, gazetteer_towns, candidate_union, resolve_overlaps, truth_totals, override_problems,
    three_way_compare, surviving_fragments, classify_substitutions, verdict_counts, doc_scorecard, kind_scorecard, category_scorecard, headline_metrics, ci_gate, applied_confidence,
)}


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def extracted(patterns, name="name") -> str:
    return " UNION ".join(f"SELECT DISTINCT trim(unnest(regexp_extract_all(text, {quoted(p)}, 1))) AS {name} FROM tickets" for p in patterns)


FOLD = r"regexp_replace(regexp_replace(translate(replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'éèêëàâçîïôû', 'eeeeaaciiou'), '[''\s]+', '.', 'g'), '[^a-z.-]', '', 'g')"
SHAPED = " UNION ALL ".join(
    f"""SELECT doc_id, text, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS integer) AS s, ms[i] AS value, '{kind}' AS kind, 'strong' AS tier, {n} AS ordinal
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {quoted(p)}) AS ms, string_split_regex(text, {quoted(p)}) AS gaps FROM tickets) x WHERE len(ms) > 0) y"""
    for n, (kind, p) in enumerate(truth.SHAPES)
)

#: The ground truth step by step: names, literals and where they stand, shapes, and the greedy choice as a recursion.
TRUTH = f"""RECURSIVE tickets AS ({fixtures.TICKETS.format(customer='customer')}),
vouched AS ({extracted(gazetteer.VOUCHERS)}),
parts AS (SELECT DISTINCT lower(part) AS part FROM ({extracted([gazetteer.LOCAL_PART], 'part')}) x),
pairs AS ({extracted([gazetteer.FULL_NAME])}),
known AS (SELECT name FROM pairs WHERE {FOLD.format(x='name')} IN (SELECT part FROM parts)),
people AS (SELECT name FROM vouched UNION SELECT name FROM known),
orgs_all AS ({extracted([gazetteer.ORGANISATION])}),
orgs AS (SELECT name FROM orgs_all c WHERE NOT EXISTS (SELECT 1 FROM orgs_all o WHERE length(o.name) < length(c.name) AND ends_with(c.name, ' ' || o.name))),
weak AS (SELECT DISTINCT part, name FROM (SELECT 'first' AS part, split_part(name, ' ', 1) AS name FROM people UNION ALL SELECT 'last', substr(name, instr(name, ' ') + 1) FROM people) x WHERE name NOT IN (SELECT unnest(string_split(name, ' ')) FROM orgs)),
towns_found AS ({extracted([gazetteer.TOWN])}),
towns AS (SELECT name FROM towns_found UNION SELECT regexp_extract(name, '\\sbei\\s(.+)$', 1) FROM towns_found WHERE regexp_matches(name, '\\sbei\\s')),
literals AS (SELECT name AS value, 'PERSON' AS kind, 'strong' AS tier, 100 AS ordinal FROM people UNION ALL SELECT name, 'ORG', 'strong', 101 FROM orgs UNION ALL SELECT name, 'LOCATION', 'strong', 102 FROM towns UNION ALL SELECT DISTINCT name, 'PERSON', 'weak', 103 FROM weak),
split AS (SELECT t.doc_id, t.text, l.*, string_split(t.text, l.value) AS gaps FROM tickets t JOIN literals l ON contains(t.text, l.value)),
places AS (SELECT doc_id, text, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(value) AS integer) AS s, value, kind, tier, ordinal FROM (SELECT *, unnest(range(1, len(gaps))) AS i FROM split) x),
alone AS (SELECT * FROM places WHERE NOT regexp_matches(CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END, '[\\p{{L}}\\d.]') AND NOT regexp_matches(substr(text, s + length(value) + 1, 1), '[\\p{{L}}\\d]')),
shaped AS ({SHAPED}),
every AS (SELECT doc_id, text, s, s + length(value) AS e, value, CASE WHEN kind = 'DATE' AND regexp_matches(substr(text, greatest(1, s - 23), least(24, s)), '(?i)(?:geboren am|Geburtsdatum|geb\\.)\\s*$') THEN 'BIRTHDATE' ELSE kind END AS kind, tier, ordinal FROM (SELECT * FROM shaped UNION ALL SELECT * FROM alone) x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, ordinal, kind, value, tier) AS i FROM every),
chosen AS (SELECT *, true AS kept, e AS last FROM ranked WHERE i = 1 UNION ALL SELECT r.*, r.s >= c.last, CASE WHEN r.s >= c.last THEN r.e ELSE c.last END FROM chosen c JOIN ranked r ON r.doc_id = c.doc_id AND r.i = c.i + 1),
entities AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS integer) AS index, kind, value, s, e, tier, text,
  CASE WHEN value IN ({', '.join(quoted(k) for k in KEEP)}) THEN 'keep' WHEN kind IN ({', '.join(quoted(k) for k in truth.REDACT)}) THEN 'redact' ELSE 'informational' END AS policy FROM chosen WHERE kept)"""

#: What the made redaction does to each entity, without any alignment of texts.
JUDGED = TRUTH + """,
turns AS (SELECT *, (doc_id + s) % 4 AS turn, kind = 'PERSON' AND tier = 'strong' AND (doc_id + s) % 4 = 1 AS half FROM entities),
hidden AS (SELECT *, CASE policy WHEN 'redact' THEN turn <> 0 WHEN 'keep' THEN turn = 2 ELSE turn = 3 END AS hide FROM turns),
judged AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN NOT hide THEN 'leaked' WHEN half AND regexp_matches(split_part(value, ' ', 2), '\\p{L}{4,}') THEN 'partial' ELSE 'replaced' END AS outcome,
  CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 5 = 0 AND hide THEN 'damaged' ELSE 'restored' END AS restoration FROM hidden),
apart AS (SELECT *, CASE WHEN regexp_full_match(substr(text, last_e + 1, s - last_e), '[ \t]+[<(]?') THEN 0 ELSE 1 END AS starts FROM (SELECT *, lag(CASE WHEN half THEN CAST(s + instr(value, ' ') - 1 AS integer) ELSE e END) OVER (PARTITION BY doc_id ORDER BY s) AS last_e FROM judged WHERE hide AND doc_id % 13 <> 0) x),
groups AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM apart),
subs AS (SELECT doc_id, g, CASE WHEN bool_or(policy = 'redact') THEN 'expected' WHEN bool_or(policy = 'keep') THEN 'over-redaction' ELSE 'collateral' END AS verdict FROM groups GROUP BY doc_id, g),
scores AS (SELECT t.doc_id, count(j.index) AS entities, count(*) FILTER (j.policy = 'redact') AS redactable, count(*) FILTER (j.policy = 'redact' AND outcome = 'replaced') AS replaced, count(*) FILTER (j.policy = 'redact' AND outcome = 'partial') AS partial, count(*) FILTER (j.policy = 'redact' AND outcome = 'leaked') AS leaked,
  count(*) FILTER (j.policy = 'keep' AND outcome IN ('replaced', 'partial')) AS over_redacted, count(*) FILTER (j.policy = 'redact' AND restoration = 'damaged') AS damaged,
  count(*) FILTER (j.policy = 'redact' AND tier = 'strong') AS strong, count(*) FILTER (j.policy = 'redact' AND tier = 'strong' AND outcome IN ('replaced', 'partial')) AS strong_hidden,
  count(*) FILTER (j.policy = 'redact' AND tier = 'weak') AS weak, count(*) FILTER (j.policy = 'redact' AND tier = 'weak' AND outcome IN ('replaced', 'partial')) AS weak_hidden FROM tickets t LEFT JOIN judged j ON t.doc_id = j.doc_id GROUP BY t.doc_id)"""
COUNTS = "count(*) FILTER (verdict = 'expected') AS expected, count(*) FILTER (verdict = 'over-redaction') AS over_redaction, count(*) FILTER (verdict = 'collateral') AS collateral, count(*) FILTER (verdict = 'unclassified') AS unclassified"

ORACLE = {
    "template_tickets": fixtures.TICKETS.format(customer="customer"),
    "vouched_names": f"WITH {TRUTH} SELECT name FROM vouched",
    "gazetteer_people": f"WITH {TRUTH} SELECT name FROM people",
    "corroborated_names": f"WITH {TRUTH} SELECT name FROM known",
    "org_suffix_antijoin": f"WITH {TRUTH} SELECT name AS org FROM orgs",
    "names_except": f"WITH {TRUTH} SELECT part, name FROM weak",
    "gazetteer_towns": f"WITH {TRUTH} SELECT name, length(name) AS size FROM towns",
    "candidate_union": f"WITH {TRUTH} SELECT kind, tier, count(*) AS n, CAST(sum(length(value)) AS bigint) AS chars FROM every GROUP BY kind, tier",
    "resolve_overlaps": f"WITH {TRUTH} SELECT doc_id, index, kind, value, s AS start_, e AS end_, tier, policy, CAST(len(string_split(substr(text, 1, s), chr(10))) AS integer) AS line FROM entities",
    "truth_totals": f"WITH {TRUTH} SELECT 'policy' AS grouping, policy AS key, count(*) AS n FROM entities GROUP BY policy UNION ALL SELECT 'tier', tier, count(*) FROM entities GROUP BY tier UNION ALL SELECT 'kind', kind || CASE WHEN tier = 'weak' THEN ' (weak)' ELSE '' END, count(*) FROM entities GROUP BY 2",
    "override_problems": f"WITH {TRUTH}, g AS (SELECT doc_id * CASE WHEN doc_id % 30 = 0 THEN -1 ELSE 1 END AS doc_id, substr(text, 1, 10) = substr(text, CAST(doc_id % 20 + 1 AS integer), 10) AND (doc_id % 30 <> 0 OR doc_id = 0) AS fits FROM tickets WHERE doc_id % 10 = 0) SELECT doc_id, CASE WHEN doc_id < 0 THEN 'no document' WHEN fits THEN '' ELSE 'is not at' END AS problem, CAST(CASE WHEN fits THEN 1 ELSE 0 END AS bigint) AS n_entities FROM g",
    "three_way_compare": f"WITH {JUDGED} SELECT doc_id, index, kind, outcome, restoration FROM judged",
    "surviving_fragments": f"WITH {JUDGED} SELECT doc_id, index, split_part(value, ' ', 2) AS survived, CAST(instr(value, ' ') - 1 AS integer) AS covered FROM judged WHERE outcome = 'partial'",
    "classify_substitutions": f"WITH {JUDGED} SELECT doc_id, verdict, count(*) AS n FROM subs GROUP BY doc_id, verdict",
    "verdict_counts": f"WITH {JUDGED} SELECT {COUNTS} FROM subs",
    "doc_scorecard": f"WITH {JUDGED} SELECT *, doc_id % 13 <> 0 AND leaked = 0 AS clean, doc_id % 11 <> 0 AND damaged = 0 AS intact, doc_id % 13 <> 0 AND over_redacted = 0 AS faithful FROM scores",
    "kind_scorecard": f"WITH {JUDGED} SELECT kind, count(*) AS total, count(*) FILTER (outcome = 'replaced') AS replaced, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'leaked') AS leaked, count(*) FILTER (restoration = 'damaged') AS damaged FROM judged WHERE policy = 'redact' GROUP BY kind",
    "category_scorecard": f"WITH {JUDGED} SELECT 'template ' || doc_id % 7 AS category, count(*) AS n_docs, CAST(sum(redactable) AS bigint) AS redactable, CAST(sum(leaked) AS bigint) AS leaked, CAST(sum(damaged) AS bigint) AS damaged FROM scores GROUP BY 1",
    "headline_metrics": f"""WITH {JUDGED}, v AS (SELECT {COUNTS} FROM subs), s AS (SELECT CAST(sum(redactable) AS double) AS n, sum(replaced + partial) AS hidden, sum(damaged) AS damaged, CAST(sum(strong) AS double) AS strong, sum(strong_hidden) AS strong_hidden, CAST(sum(weak) AS double) AS weak, sum(weak_hidden) AS weak_hidden FROM scores)
        SELECT round(hidden / nullif(n, 0), 9) AS coverage, round(strong_hidden / nullif(strong, 0), 9) AS strong_coverage, round(weak_hidden / nullif(weak, 0), 9) AS weak_coverage, round((n - damaged) / nullif(n, 0), 9) AS restoration, round(CAST(expected AS double) / nullif(expected + over_redaction, 0), 9) AS precision, round(CAST(expected AS double) / nullif(expected + over_redaction + collateral + unclassified, 0), 9) AS strict_precision FROM s, v""",
    "ci_gate": f"WITH {JUDGED}, f AS (SELECT count(*) AS failed FROM tickets WHERE doc_id % 11 = 0 OR doc_id % 13 = 0) SELECT CAST(sum(leaked) AS bigint) AS leaked, CAST(sum(damaged) AS bigint) AS damaged, any_value(failed) AS failed, sum(leaked) = 0 AND sum(damaged) = 0 AND any_value(failed) = 0 AS passes FROM scores, f",
    "applied_confidence": f"WITH {TRUTH} SELECT kind, round(avg(CASE WHEN tier = 'weak' THEN 0.65 WHEN kind IN ('PERSON', 'ORG', 'LOCATION') THEN 0.85 ELSE 1.0 END), 9) AS confidence, count(*) AS n FROM entities GROUP BY kind",
}
