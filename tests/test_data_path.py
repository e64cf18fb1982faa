"""Bodies redacted in place, policies, bounded reads, exact ranks, overlapping spans, seeded draws, and sequence labels."""

import gzip
import json
import random
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions import detect
from veilwork.operators import intervals, mutation, names, permuted, ranks, vault
from veilwork.sources import bodies, fixtures, policy

BODY = "doc_id long, client string, host string, body binary, content_type string, content_encoding string"


def message(i, body, kind="application/json", encoding=None, client="c"):
    return (i, client, "h", body.encode() if isinstance(body, str) else body, kind, encoding)


def test_breakpoints_lead_from_decoded_to_raw():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice('ab"\\\n\té😀ü/') for _ in range(rng.randint(0, 20)))
        raw = json.dumps(text, ensure_ascii=rng.random() < 0.5)[1:-1].replace("/", rng.choice(["/", "\\/"]))
        marks = mutation.breaks(raw)
        for at in range(len(text) + 1):
            low = max((k for k, m in enumerate(marks) if m["decoded"] <= at), default=None)
            found = at if low is None else marks[low]["raw"] + at - marks[low]["decoded"]
            assert json.loads(f'"{raw[:found]}"') == text[:at]


def test_bodies_are_redacted_in_place_and_come_back(spark):
    mail, ip = "ann@example.org", "10.1.2.3"
    sent = [
        message(1, f'{{ "a\\u00e9" : "to {mail},\\n and \\ud83d\\ude00 {ip}" , "{mail}": [1, "{mail}"] }} // {mail}'),
        message(2, f"plain {mail}", "text/plain"), message(3, f'{{"cut": "{mail}"', "application/json"), message(4, '{"n": 1}'), message(5, ""), message(6, None),
        message(7, gzip.compress(f'["{mail}"]'.encode()), encoding="gzip"), message(8, b"\x1f\x8b broken", encoding="gzip"), message(9, b"\xff\xfe", "text/plain; charset=utf-8"),
        message(10, "x" * 2000 + mail, "text/plain"), message(11, f'["{mail}"]', client="other"), message(12, f"{mail} né".encode("latin-1"), "text/plain; charset=iso-8859-1"), message(13, f'"a\\"{mail}\\\\"'), message(13, f'"a\\"{mail}\\\\"'),
    ]
    rows = spark.createDataFrame(sent, BODY)
    treated = mutation.redacted(rows, "key", limit=1500).persist()
    got = {r["doc_id"]: r for r in treated.collect()}
    token = {t["value"]: t["standin"] for t in got[1]["tokens"]}
    assert set(token) == {mail, ip} and {i: r["status"] for i, r in got.items()} == {1: "treated", 2: "treated", 3: "treated", 4: "clean", 5: "clean", 6: "none", 7: "treated", 8: "refused", 9: "refused", 10: "refused", 11: "treated", 12: "treated", 13: "treated"}
    # keys, comments, white space and escapes stay as they are
    assert got[1]["redacted"] == f'{{ "a\\u00e9" : "to {token[mail]},\\n and \\ud83d\\ude00 {token[ip]}" , "{mail}": [1, "{token[mail]}"] }} // {mail}'
    assert got[3]["redacted"] == f'{{"cut": "{token[mail]}"' and got[7]["redacted"] == f'["{token[mail]}"]' and got[12]["redacted"] == f"{token[mail]} né" and got[13]["redacted"] == f'"a\\"{token[mail]}\\\\"'
    assert all(got[i]["redacted"] is None for i in (6, 8, 9, 10)) and token[mail] not in got[11]["redacted"] and mail not in got[11]["redacted"]
    pairs = mutation.pairs_of(treated)
    answers = [message(1, f'{{"said": "{token[mail]}"}}'), message(2, f'{{"said": "{token[mail]}"}}', client="other"), message(3, b"\x1f\x8b broken", encoding="gzip"), message(4, None)]
    back = {r["doc_id"]: (r["status"], None if r["restored"] is None else bytes(r["restored"]), r["n_restored"]) for r in mutation.restored(spark.createDataFrame(answers, BODY), pairs).collect()}
    assert back == {1: ("restored", f'{{"said": "{mail}"}}'.encode(), 1), 2: ("restored", f'{{"said": "{token[mail]}"}}'.encode(), 0), 3: ("kept", b"\x1f\x8b broken", 0), 4: ("none", None, 0)}


def test_mutations_by_name(spark):
    rows = spark.createDataFrame([message(1, "ann@example.org", "text/plain")], BODY)
    assert mutation.mutated(rows, "k", "passthrough").first()["redacted"] == "ann@example.org"
    assert mutation.mutated(rows, "k").first()["status"] == "treated"
    with pytest.raises(ValueError, match="no mutation"):
        mutation.mutated(rows, "k", "else")
    assert mutation.mutated(rows.limit(0), "k").collect() == []


def test_texts_are_cut_at_spans_and_needles(spark):
    df = spark.sql("select 'ab😀cd' text, array(named_struct('start', 0, 'end', 1), named_struct('start', 2, 'end', 4)) s")
    cut = [tuple(p) for p in df.select(mutation.split_at("text", "s").alias("p")).first()["p"]]
    assert cut == [("a", 0), ("b", None), ("😀c", 1), ("d", None)]
    by = lambda text, needles: [tuple(p) for p in spark.createDataFrame([(text,)], "text string").select(mutation.split_by("text", needles).alias("p")).first()["p"]]
    assert by("anna an a", ["an", "anna", "'", ""]) == [("anna", 1), (" ", None), ("an", 0), (" a", None)]
    assert by("x", []) == [("x", None)] and by("", ["a"]) == []


def test_numbers_inside_longer_numbers_are_none(spark):
    rows = ["9123-45-67890", "440514014589", "A4111111111111111", "1.2.3.4567", "x123 456 7890y", "17560.9217.0769.85", "4111 1111 1111 1112 3", "4111-1111-1111-1111", "2001:db8:0:0:0:0:0:1", "fe80::1", "1:2", "12:30::45:1:2:3:4:5:6"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sure = {(rows[r["doc_id"]], r["kind"]) for r in detect.findings(df).where(f"score >= {detect.THRESHOLD}").collect()}
    assert sure == {("4111-1111-1111-1111", "CREDIT_CARD_NUMBER"), ("2001:db8:0:0:0:0:0:1", "IP_ADDRESS"), ("fe80::1", "IP_ADDRESS")}


def test_files_beyond_the_limit_are_not_read(spark, tmp_path):
    for name, size in (("a", 0), ("b", 10), ("c", 11), ("d", 5000)):
        (tmp_path / name).write_bytes(b"x" * size)
    frame = bodies.files(spark, str(tmp_path), 10)
    got = {r["path"][-1]: (r["length"], None if r["body"] is None else len(r["body"])) for r in frame.collect()}
    assert got == {"b": (10, 10), "c": (11, None), "d": (5000, None)}
    plan = frame._jdf.queryExecution().toString()
    # the file source knows the limit, and of larger files it reads no content
    assert "LessThanOrEqual(length,10)" in plan and "ReadSchema: struct<path:string,length:bigint>" in plan.replace("\n", "")
    assert all(r["body"] is not None for r in bodies.files(spark, str(tmp_path), 0).collect())


def test_policies_of_odd_files(spark):
    given = [None, "", "{", "[]", "3", '{"redact": []}', '{"keep": ["a", 1]}', '{"keep": "a"}', '{"redact": null, "keep": ["a"], "x": {}}']
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, text string")
    got = {r["i"]: (tuple(r["p"]["redact"]), tuple(r["p"]["keep"])) for r in df.select("i", policy.merged(F.col("text"), policy.POLICY).alias("p")).collect()}
    base = tuple(policy.POLICY["redact"])
    assert got == {0: (base, ()), 1: (base, ()), 2: (base, ()), 3: (base, ()), 4: (base, ()), 5: ((), ()), 6: (base, ()), 7: (base, ()), 8: (base, ("a",))}
    s = spark.range(1).select(policy.merged(F.lit('{"threshold": 0.25, "inspect": false, "ttl_hours": 1.5, "hosts": ["h"]}'), policy.SETTINGS).alias("s")).first()["s"]
    assert (s["threshold"], s["inspect"], s["ttl_hours"], s["hosts"], s["clients"]) == (0.25, False, 48, ["h"], 512)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_order_statistics(spark, broadcast, monkeypatch):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ranks, "BARS", 4)
    rng = random.Random(6)
    values = {"even": [float(i) for i in range(40)], "one": [3.5], "same": [2.0] * 30, "far": [1e-300, 1.0, 2.0, 1e300, -1e300], "mixed": [rng.choice([rng.gauss(0, 1), 0.0, 5.0]) for _ in range(90)], "odd": [None, float("nan"), 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "key string, value double").repartition(4)
    got = {r["key"]: (r["n"], r["p50"], r["p95"], r["last"]) for r in ranks.order_statistics(df, "key", "value", {"p50": ranks.nearest_rank(0.5), "p95": ranks.nearest_rank(0.95), "last": F.col("n") - 1}).collect()}
    clean = {k: sorted(v for v in vs if v is not None and v == v) for k, vs in values.items()}
    assert got == {k: (len(v), v[min(len(v) - 1, int(0.5 * len(v)))], v[min(len(v) - 1, int(0.95 * len(v)))], v[-1]) for k, v in clean.items()}
    numbered = ranks.numbered(df.where("value is not null"), "value", "key").orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(len(numbered)))
    assert ranks.order_statistics(df.limit(0), "key", "value", {"p": F.col("n") - 1}).collect() == []


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_overlapping_spans(spark, width):
    rng = random.Random(8)
    some = lambda n: [(rng.randrange(3), s, s + rng.choice([0, 1, 3, 30])) for s in (rng.randrange(60) for _ in range(n))]
    a, b = some(60) + [(0, 0, 500), (1, None, 3)], some(60) + [(0, 5, 5), (0, 5, 5), (2, 3, None)]
    schema = "doc_id long, start int, end int"
    got = sorted((r["doc_id"], r["start"], r["end"], r["b_start"], r["b_end"]) for r in intervals.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "doc_id", width).collect())
    assert got == sorted((k, s, e, t, u) for k, s, e in a for j, t, u in b if j == k and None not in (s, e, t, u) and s < u and t < e)


def test_draws_are_those_of_the_generator_in_turn(spark):
    state, expected = 7, []
    for _ in range(200):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61))) & 0xFFFFFFFF
        expected.append(((t ^ t >> 14) & 0xFFFFFFFF) / 2**32)
    got = spark.range(1, 201).select("id", fixtures.seeded(7, F.col("id")).alias("x")).orderBy("id").collect()
    assert [r["x"] for r in got] == expected


def test_labels_are_the_best_sequence():
    rng = np.random.default_rng(1)
    w = names.Weights(["A", "B"])
    for n in (1, 2, 4, 5):
        w.packed[:] = 0
        x = np.arange(n)[:, None]
        w.emit[:n], w.move[:], w.start[:] = rng.normal(size=(n, 5)), rng.normal(size=(5, 5)), rng.normal(size=5)
        value = lambda t: w.start[t[0]] + w.unbegun[t[0]] + sum(w.emit[i, k] for i, k in enumerate(t)) + sum(w.move[a, b] + w.barred[a, b] for a, b in zip(t, t[1:]))
        every = {t: value(t) for t in product(range(5), repeat=n)}
        assert tuple(w.label(x)) == max(every, key=every.get)
        best = max(every.values())
        assert np.allclose(w.margins(x), [best - max(v for t, v in every.items() if t[i] == 0) for i in range(n)])


def test_names_on_held_out_tickets(spark):
    """Learned from three quarters of the tickets; names in the rest, and names that no ticket has."""
    from veilwork.operators import truth

    docs = fixtures.tickets(spark, "/root/testdata/sf0.001").persist()
    known = truth.entities(docs).persist()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    weights = names.learned(docs.where(~held), known.where(~held), ["PERSON", "ORG", "LOCATION"])
    scores = {r["kind"]: (r["precision"], r["recall"]) for r in names.agreement(names.findings(docs.where(held), weights), known.where(held).where("kind in ('PERSON', 'ORG', 'LOCATION')")).collect()}
    assert min(min(x) for x in scores.values()) > 0.8, scores
    new = spark.createDataFrame([(1, "Erstkontakt Rahel Obrecht (+41 79 566 86 75) oder Urs Winkelried (Netzwerk)"), (2, None), (3, ""), (4, "12 -- 3")], "doc_id long, text string")
    found = [(r["doc_id"], r["value"]) for r in names.findings(new, weights).where("kind = 'PERSON'").collect()]
    assert set(found) >= {(1, "Urs Winkelried")} and all(i == 1 for i, _ in found)
    none = names.learned(docs.limit(0), known.limit(0), ["PERSON"])
    assert names.findings(docs, none).count() == 0


def test_keyed_standins_are_valid_and_never_shared(spark):
    every = spark.range(10_000).select(F.lit("US_SOCIAL_SECURITY_NUMBER").alias("kind"), F.format_string("%04d", "id").alias("value"))
    small = every.select(permuted.standin("kind", "value", "k").alias("s"))
    assert small.where("length(s) != 4").isEmpty() and small.distinct().count() == 10_000
    records = detect.findings(fixtures.records(spark, "/root/testdata/sf0.001"), list(permuted.RULES)).where(f"score >= {detect.THRESHOLD}").select("kind", "value").distinct()
    found = records.withColumn("standin", permuted.standin("kind", "value", "secret")).persist()
    assert found.where("standin is null or standin = value").count() < 3 and found.select("kind", "standin").distinct().count() == found.count() > 300
    again = detect.findings(found.select(F.monotonically_increasing_id().alias("doc_id"), F.col("standin").alias("text"), "kind").select("doc_id", "text")).where(f"score >= {detect.THRESHOLD}")
    assert again.where(F.col("kind").isin(*permuted.RULES)).select("value").distinct().count() == found.select("standin").distinct().count()
    other = found.select((F.col("standin") != permuted.standin("kind", "value", "else")).alias("x"))
    assert other.where("x").count() > 0.9 * found.count()
    odd = spark.createDataFrame([("EMAIL_ADDRESS", "a@b.org"), ("PHONE_NUMBER", None), ("PHONE_NUMBER", "+41 1")], "kind string, value string")
    assert [r[0] for r in odd.select(permuted.standin("kind", "value", "k")).collect()] == [None] * 3


@pytest.mark.parametrize("share", [1 << 16, 3])
def test_restore_of_a_large_vault(spark, monkeypatch, share):
    """A vault with many texts is several shares; each text comes back once, with its own columns."""
    from veilwork.operators import vault

    monkeypatch.setattr(vault, "SHARE", share)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}", "h", f"say S{i % 4} and S{i % 7}!", "odd") for i in range(120)] + [(200, None, "h", "S1", "x"), (201, "hot", None, "S1", "x"), (202, "hot", "h", None, "x"), (203, "new", "h", "S1", "x"), (5, "hot", "h", "S1", "x")]
    texts = spark.createDataFrame(rows, "n long, client string, host string, text string, row string")
    pairs = spark.createDataFrame([(c, "h", f"S{k}", f"{c}-{k}") for c in ("hot", "c0", "c1", "c2") for k in range(7)] + [(None, "h", "S1", "no"), ("hot", "h", "", "no")], "client string, host string, standin string, value string")
    out = vault.restore(texts, pairs)
    assert out.columns == ["n", "client", "host", "text", "row", "n_restored"]
    known = {"hot", "c0", "c1", "c2"}
    put = lambda c, h, t: t if t is None or c not in known or h != "h" else "".join(f"{c}-{p[0]}{p[1:]}" if k else p for k, p in enumerate(t.split("S")))
    expected = [(n, c, h, put(c, h, t), r, t.count("S") if t and put(c, h, t) != t else 0) for n, c, h, t, r in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_large_vaults_are_looked_up(spark, monkeypatch):
    """Texts that look their stand-ins up come back as those whose vault comes whole."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice('ab1Bé"\\<😀') for _ in range(rng.randint(1, 5)))
    pairs = [(c, "h", word(), f"{c}{i}é") for c in ("c", "d") for i in range(60)] + [("c", "h", "longer stand-in 0a of 1b", "x"), (None, "h", "a", "no"), ("c", "h", "", "no")]
    texts = []
    for i in range(300):
        said = " ".join(rng.choice((word(), rng.choice(pairs)[2], "longer stand-in 0f of 1b", "longer stand-in 0a of 1b")) for _ in range(rng.randint(0, 12)))
        as_json = i % 3 > 0
        texts.append((i, rng.choice(("c", "d", "e", None)), rng.choice(("h", "h", "h", None)), json.dumps(said, ensure_ascii=i % 3 == 1) if as_json else said if i % 7 else None, "Json" if as_json else "Text", "odd"))
    texts = spark.createDataFrame(texts + texts[:40], "n long, client string, host string, text string, syntax string, row string")
    pairs = spark.createDataFrame(pairs + pairs, "client string, host string, standin string, value string")
    for syntax in ("syntax", None):
        whole = vault.restore(texts, pairs, "text", syntax)
        monkeypatch.setattr(vault, "HELD", 1)
        monkeypatch.setattr(vault, "beside", None)
        found = vault.restore(texts, pairs, "text", syntax)
        monkeypatch.undo()
        assert found.columns == whole.columns == [*texts.columns, "n_restored"]
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.where("n_restored > 2").count() > 50
    monkeypatch.setattr(vault, "HELD", 1)
    # a search of few and of overlapping places
    few = {"aa": "x", "aaa": "y", "b": "", '\\"': "z"}
    for said in ("aaaa b aab", 'b\\"aa', "", "ba"):
        assert vault.replaced(few)(said) == vault.replacer(few)(said)
    assert vault.restore(texts.limit(0), pairs).count() == 0 and vault.restore(texts, pairs.limit(0)).count() == texts.count()


def test_values_that_get_the_same_standin_come_back(spark, monkeypatch):
    monkeypatch.setattr(vault, "standin", lambda kind, digest: F.concat(F.lit('<"'), kind, F.left(digest, F.lit(1)), F.lit("é>")))
    rows = [message(i, json.dumps({"a": f"m{i}@example.org, 10.0.0.{i} m{i + 1}@example.org", "b": ["m1@example.org"] * (i % 3)}, ensure_ascii=i % 2 == 0) if i % 5 else f"m{i}@example.org\n10.0.0.{i}", "application/json" if i % 5 else "text/plain", client=f"c{i % 2}" if i % 20 else None) for i in range(120)]
    rows += [message(200, None), message(201, b"\x1f\x8b broken", encoding="gzip"), message(202, "nothing", "text/plain"), rows[7]]
    sent = mutation.redacted_apart(spark.createDataFrame(rows, BODY), "key")
    plain = mutation.redacted(spark.createDataFrame(rows, BODY), "key")
    state = ["doc_id", "client", "status", "found"]
    assert sorted(map(str, sent.select(state).collect())) == sorted(map(str, plain.select(state).collect())) and sent.columns == plain.columns
    pairs = mutation.pairs_of(sent)
    assert vault.collisions(pairs.where("client is not null")).count() == 0 and vault.collisions(mutation.pairs_of(plain).where("client is not null")).count() > 10
    answers = sent.select("doc_id", "client", "host", F.coalesce(F.encode("redacted", "UTF-8"), F.col("body")).alias("body"), "content_type", "content_encoding")
    expected = {r[0]: r[3] for r in rows if r[1] is not None}
    for held in (vault.HELD, 1):
        monkeypatch.setattr(vault, "HELD", held)
        back = {r["doc_id"]: r["restored"] and bytes(r["restored"]) for r in mutation.restored(answers, pairs).where("client is not null").collect()}
        assert back == expected


def test_one_search_finds_what_each_kind_finds_by_itself(spark):
    lines = [f"{i}: 10.0.{i}.1, http://a\x01b\x02c {i}@b.de\x02 1980-01-0{i % 9 + 1} 12345678901 12345678901 fe80::1:{i}" if i % 50 else "no such thing" for i in range(200)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "é12345678901 0A:1F:11:22:33:44:55\x01\r\n\n4@ü.de"), (3, ""), (4, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["kind"], r["start"], r["end"], r["value"]) for r in detect.findings(docs).collect()}
    alone = {(r["doc_id"], k.kind, *r["m"]) for k in detect.RECOGNISERS for r in docs.where("text is not null").select("doc_id", F.explode(detect.matches("text", k.pattern)).alias("m")).collect()}
    assert found == alone and len(found) > 1000
    sql = detect.found_sql("text")
    assert sql.count("regexp_replace(replace(") <= 3 + 1 and "split(lines.value, '" not in sql  # not a search a kind and line


def test_words_are_searched_by_their_first_character():
    assert detect.begins(r"\b[A-CEG][0-9]\b") == ("A-Z",) and detect.begins(r"(?i)\baccount") == ("A-Z", "a-z") and detect.begins(r"\b756\.") == ("0-9",)
    assert all(detect.begins(p) == detect.STARTS for p in (r"\b(?:1|a)", r"\b[0-9]?a", r"\b1*a", r"\b[0-9]{0,2}a", r"\b[0-9A-Fa-f]:", r"\b[0-9]\.|\ba", r"\b1|a"))
    sql = detect.by_word_sql("text", [detect.BY_KIND["US_PASSPORT_NUMBER"], detect.BY_KIND["AHV"]])
    assert sql.count("regexp_replace(if(contains(") == 2  # none from a-z on


def test_texts_made_of_a_small_table_are_dealt_to_all_tasks(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for rows in (fixtures.records(spark, str(tmp_path)), fixtures.tickets(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert rows.count() == 50


def test_restoring_takes_no_longer_with_more_pairs():
    rng = random.Random(5)
    for _ in range(300):
        pairs = {"".join(rng.choice("ab1é") for _ in range(rng.randint(1, 4))): rng.choice(["", "x", "yab"]) for _ in range(rng.randint(1, 9))}
        text = "".join(rng.choice("ab1é ") for _ in range(rng.randint(0, 30)))
        look = vault.restorer(pairs)
        assert vault.replacer(pairs)(text) == look.subn(lambda m: pairs[m[0]], text)
    many = {f"<ID:{i:08x}>": str(i) for i in range(200_000)}
    began = time.perf_counter()
    assert vault.replacer(many)("".join(f"{x}, " for x in list(many)[:5000]))[1] == 5000
    assert vault.replacer(many)("<ID:zzzz " * 5000) == ("<ID:zzzz " * 5000, 0)
    assert time.perf_counter() - began < 20


def test_features_of_a_token_are_kept():
    names.numbered.cache_clear()
    once, again = names.featured(["Frau", "Meier", ",", "3"]), names.featured(["Frau", "Meier", ",", "3"])
    assert (once == again).all() and names.numbered.cache_info().hits == 4
