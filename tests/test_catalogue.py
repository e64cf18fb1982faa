"""Every query of the catalogue against its SQL on the smallest tables, and the functions on rows made by hand."""

import math
from collections import Counter
from hashlib import md5

import duckdb
import pytest

from veilwork import facts
from veilwork.functions import detect, text as T
from veilwork.operators import evaluate, literals, spans, vault
from veilwork.plans import catalogue, privacy
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark pages labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = oracle.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE.keys()))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_redacted_text_is_spliced_from_its_stand_ins(spark):
    """Each digest and length against the text put together here from what was kept."""
    digests = {r["doc_id"]: (r["n_spans"], r["digest"]) for r in catalogue.QUERIES["redact_text"](spark, SF).collect()}
    sizes = {r["doc_id"]: r["redacted_len"] for r in catalogue.flagship(spark, SF).collect()}
    rows = privacy.chosen(spark, SF).collect()
    for r in rows:
        out, at = [], 0
        for k in r["kept"]:
            assert r["text"][k["start"] : k["end"]] == k["value"] and k["start"] >= at
            out += r["text"][at : k["start"]], k["standin"]
            at = k["end"]
        text = "".join([*out, r["text"][at:]])
        assert (len(r["kept"]), md5(text.encode()).hexdigest()) == digests[r["doc_id"]] and len(text) == sizes[r["doc_id"]]
    assert len(rows) == len(digests) == len(sizes) > 0


def test_facts_are_53_kinds(spark):
    assert facts.facts(spark).count() == 53


def test_greedy_choice_looks_at_kept_spans_only(spark):
    df = spark.sql("select array(named_struct('start', 12, 'end', 20), named_struct('start', 5, 'end', 30), named_struct('start', 0, 'end', 10)) s")
    kept = df.select(spans.non_overlapping("s").alias("k")).first()["k"]
    assert [(k["start"], k["end"]) for k in kept] == [(0, 10), (12, 20)]


def test_fragments_are_what_no_cover_hides(spark):
    df = spark.sql("select 2 s, 20 e, array(named_struct('start', 0, 'end', 4), named_struct('start', 6, 'end', 9), named_struct('start', 8, 'end', 12)) c")
    out = df.select(spans.fragments("s", "e", "c").alias("f")).first()["f"]
    assert [(f["start"], f["end"]) for f in out] == [(4, 6), (12, 20)]


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([(1, "😀 a@b.org, 10.0.0.300"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["kind"], r["start"], r["end"], r["score"]) for r in detect.findings(df, ["EMAIL_ADDRESS", "IP_ADDRESS"]).collect())
    assert got == [("EMAIL_ADDRESS", 2, 9, 1.0), ("IP_ADDRESS", 11, 21, 0.3)]


def test_iban_and_restore(spark):
    assert spark.range(1).select(T.iban_valid(F.lit("CH93 0076 2011 6238 5295 7"))).first()[0]
    assert not spark.range(1).select(T.iban_valid(F.lit("CH94 0076 2011 6238 5295 7"))).first()[0]
    texts = spark.createDataFrame([("c", "h", "Ann met Anna"), ("c", "x", "Ann"), ("c", "h", None)], "client string, host string, text string")
    pairs = spark.createDataFrame([("c", "h", "Ann", "Eve"), ("c", "h", "Anna", "Mia")], "client string, host string, standin string, value string")
    assert sorted((r["text"] or "", r["n_restored"]) for r in vault.restore(texts, pairs).collect()) == [("", 0), ("Ann", 0), ("Eve met Mia", 2)]


def test_gazetteer_tests_every_short_literal(spark, monkeypatch):
    monkeypatch.setattr(literals, "BLOCK", 100)
    texts = [(i, " ".join(f"w{(i * 7 + k) % 50}x" for k in range(9))) for i in range(20)] + [(20, None), (3, "w1x w2x")]
    items = [(i, f"w{i}x") for i in range(50)] + [(50 + i, f"w{i}x w{i + 1}x") for i in range(10)] + [(70, "w1x"), (71, "w7x w8x w9x"), (72, "")]
    got = evaluate.gazetteer_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter((d, i) for d, t in texts for i, x in items if t and x and x in t)


def test_redaction_uses_all_recognisers(spark, tmp_path):
    rows = [(1, "card 4111111111111111, not 4111111111111112"), (2, "IBAN CH93 0076 2011 6238 5295 7"), (3, "on 2024-05-17 from http://a.example.org/x@y.org"), (4, "nothing"), (5, None), (6, "123-45-6789"), (7, "AHV 756.9217.0769.85")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: [(x["kind"], x["value"]) for x in r["kept"]] for r in privacy.chosen(spark, str(tmp_path)).collect()}
    assert kept == {
        1: [("CREDIT_CARD_NUMBER", "4111111111111111")], 2: [("INTERNATIONAL_BANKING_ACCOUNT_NUMBER", "CH93 0076 2011 6238 5295 7")],
        3: [("DATE", "2024-05-17"), ("URL", "http://a.example.org/x@y.org")], 6: [("US_SOCIAL_SECURITY_NUMBER", "123-45-6789")], 7: [("AHV", "756.9217.0769.85")],
    }
    assert {r["doc_id"]: r["n_spans"] for r in privacy.flagship(spark, str(tmp_path)).collect()} == {i: len(k) for i, k in kept.items()}
