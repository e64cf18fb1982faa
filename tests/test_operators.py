"""Operators that SQL cannot express, and the awkward rows of those that it can."""

import gzip
import json
import random
import re
import time
import zlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilwork.functions import detect, text as T
from veilwork.operators import compare, exchange, gazetteer, jsontext, literals, risk, route, truth, vault
from veilwork.plans import traffic
from veilwork.sources import bodies, corpus, fixtures
from veilwork.streaming import exchange as exchanges, reports, restore, vault as live


def test_substitutions_rebuild_the_other_text_but_for_white_space(spark):
    rng = random.Random(2)
    rows = [(i, *("".join(rng.choice("ab  \n,.") for _ in range(rng.randint(0, 40))) for _ in "ab")) for i in range(400)]
    found = {}
    for r in compare.substitutions(spark.createDataFrame(rows, "doc_id int, a string, b string"), "a", "b").collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, a, b in rows:
        out, at = [], 0
        for r in sorted(found.get(i, []), key=lambda r: r["a_start"]):
            assert at <= r["a_start"] <= r["a_end"] and a[r["a_start"] : r["a_end"]] == r["before"] and r["before"] == r["before"].strip() and r["after"] == r["after"].strip()
            out += a[at : r["a_start"]], b[r["b_start"] : r["b_end"]]
            at = r["a_end"]
        assert "".join("".join([*out, a[at:]]).split()) == "".join(b.split())


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 14))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        i, j = compare.common(np.array(a, int), np.array(b, int))
        assert len(i) == len(j) == best[-1][-1] and all(a[x] == b[y] for x, y in zip(i, j)) and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_plain_loops_and_arrays_align_alike(monkeypatch):
    rng = random.Random(5)
    pairs = [["".join(rng.choice("ab c\n,") for _ in range(rng.randint(0, 60))) for _ in "ab"] for _ in range(300)]
    plain = [compare.changed(a, b) for a, b in pairs]
    monkeypatch.setattr(compare, "FEW", 0)
    assert plain == [compare.changed(a, b) for a, b in pairs]


def test_short_texts_are_aligned_at_once():
    """Two thousand tickets take about 0.3 s; with arrays for each they took about 2 s."""
    a = "Lieferung: Freiburgstrasse 12, 3280 Lyss\nKontakt am Standort Lyss ist Müller, Telefon +41 79 566 86 12"
    b = a.replace("Müller", "x123456").replace("+41 79 566 86 12", "xabcdef").replace("Freiburgstrasse 12, 3280 Lyss", "x99")
    began = time.process_time()
    assert all(len(compare.changed(a, b)) == 3 for _ in range(2000))
    assert time.process_time() - began < 1.2


def test_substitutions_of_words_lines_and_marks(spark):
    rows = [
        (1, "Frage von Werner Müller, dringend\nzweite Zeile", "Frage von Beat Zbinden, dringend\nzweite Zeile"), (2, "same", "same"), (3, "a\nb", "a"), (4, None, "a"), (5, "a", None),
        (6, "Tel. 12 34.\nok", "Tel. <P>.\nok"), (7, "a  b", "a b"), (8, "x y", "x new y"), (9, "one two\nthree", "1 two\n3"),
    ]
    got = sorted(map(tuple, compare.substitutions(spark.createDataFrame(rows, "doc_id int, a string, b string"), "a", "b").collect()))
    assert got == [(1, 10, 23, 10, 22, "Werner Müller", "Beat Zbinden"), (3, 2, 3, 1, 1, "b", ""), (6, 5, 10, 5, 8, "12 34", "<P>"), (8, 2, 2, 2, 5, "", "new"), (9, 0, 3, 0, 1, "one", "1"), (9, 8, 13, 6, 7, "three", "3")]


def test_alignment_of_many_changed_words():
    rng = random.Random(3)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(50_000)) for _ in "ab")
    found = compare.changed(a, b)
    assert len(found) > 1000 and all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(found, found[1:]))


def test_verdicts_of_insertions_and_documents_without_entities(spark):
    subs = spark.createDataFrame([(1, 5, 5), (1, 6, 9), (1, 30, 31), (2, 0, 4)], "doc_id long, a_start int, a_end int")
    entities = spark.createDataFrame([(1, 2, 5, "redact"), (1, 6, 8, "keep"), (1, 8, 12, "informational")], "doc_id long, start int, end int, policy string")
    got = {(r["doc_id"], r["a_start"]): r["verdict"] for r in compare.verdicts(subs, entities).collect()}
    assert got == {(1, 5): "expected", (1, 6): "over-redaction", (1, 30): "unclassified", (2, 0): "unclassified"}


def test_literals_stand_by_themselves(spark):
    docs = spark.createDataFrame([(1, "Bern üBern Bern. .Bern Berne (Bern) 7Bern"), (2, None), (3, ""), (4, "Biel/Bienne, Biel")], "doc_id long, text string")
    literals = spark.createDataFrame([("Bern",), ("Biel/Bienne",)], "literal string")
    assert sorted((r["doc_id"], r["start"]) for r in gazetteer.occurrences(docs, literals).collect()) == [(1, 0), (1, 11), (1, 30), (4, 0)]


def test_many_literals_in_one_pass(spark):
    rng = random.Random(4)
    words = [f"{a}{b} {c}" for a in ("Ann", "Bo", "Cy") for b in range(200) for c in range(170)]
    assert len(words) > 100_000
    texts_ = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts_)) + [(None, "Ann1 1, .Bo1 1 xCy1 1 Cy1 1")], "doc_id long, text string")
    known = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "literal string")
    began = time.monotonic()
    got = gazetteer.occurrences(docs, known).collect()
    assert time.monotonic() - began < 60 and sum(r["doc_id"] is not None for r in got) >= 2000
    assert {(r["start"], r["literal"]) for r in got if r["doc_id"] is None} == {(0, "Ann1 1"), (22, "Cy1 1")}
    assert all(texts_[r["doc_id"]][r["start"] : r["end"]] == r["literal"] for r in got if r["doc_id"] is not None)


def test_truth_of_awkward_documents(spark):
    docs = spark.createDataFrame([(1, "geb. 1980-01-02, am 1999-12-31"), (2, None), (3, ""), (4, "NAT-2025-\n4688 CHF 1'000.50 10.0.0.0/8"), (5, "Güterstrasse 24, 3008 Bern bei Bern")], "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["value"], r["policy"]) for r in truth.entities(docs).collect()}
    assert got == {(1, "BIRTHDATE", "1980-01-02", "redact"), (1, "DATE", "1999-12-31", "informational"), (4, "CONTRACT_ID", "NAT-2025-\n4688", "informational"), (4, "MONEY", "CHF 1'000.50", "informational"), (4, "IP", "10.0.0.0/8", "informational"), (5, "ADDRESS", "Güterstrasse 24, 3008 Bern bei Bern", "redact")}


def test_entities_are_found_beside_their_texts(spark, capsys):
    """No text and no candidate is shuffled: what a literal is goes with the automaton."""
    docs = spark.createDataFrame([(1, "Von: Ann Bo <ann.bo@firma.example>\nAnn Bo, 3008 Bern"), (2, "Ann Bo in Bern"), (3, None)], "doc_id long, text string")
    found = truth.entities(docs)
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert sorted((r["doc_id"], r["index"], r["kind"], r["value"], r["start"], r["line"]) for r in found.collect()) == [
        (1, 0, "PERSON", "Ann Bo", 5, 1), (1, 1, "EMAIL", "ann.bo@firma.example", 13, 1), (1, 2, "PERSON", "Ann Bo", 35, 2), (1, 3, "LOCATION", "Bern", 48, 2), (2, 0, "PERSON", "Ann Bo", 0, 1), (2, 1, "LOCATION", "Bern", 10, 1),
    ]


def test_literals_beside_texts_in_any_number_of_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "😀 Bern, Ann Bern-Lyss"), (2, None), (3, ""), (1, "Ann")], "doc_id long, text string")
    known = spark.createDataFrame([("Bern", "LOCATION", "strong", 102), ("Bern", "PERSON", "weak", 103), ("Ann", "PERSON", "weak", 103), ("Ann Bern", "PERSON", "strong", 100), ("Lyss", "LOCATION", "strong", 102), ("", "ORG", "strong", 101)], "literal string, kind string, tier string, ordinal int")
    expected = Counter(tuple(r) for r in gazetteer.occurrences(docs, known).select("doc_id", "start", "end", "literal", "kind", "tier", "ordinal").collect())
    assert len(expected) == 8
    for block in (1 << 20, 9, 4):
        monkeypatch.setattr(literals, "BLOCK", block)
        rows = literals.beside(docs, known).collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in rows) == [(1, "Ann"), (1, "😀 Bern, Ann Bern-Lyss"), (2, ""), (3, "")]
        assert Counter((r["doc_id"], *p) for r in rows for p in r["places"]) == expected
    assert [r["places"] for r in literals.beside(docs, known.limit(0)).collect()] == [[]] * 4


def test_every_match_has_a_needed_string(spark):
    """Texts that are not searched, as they have no string that every match has, hold no match."""
    odd = ["A Bo<a@", "[1:02] Ann Bo :", "An:Ann Bo", "Kommentar Ann Bo", "Ann Bo (HR", "|x| Ann Bo |", "Ann Bo\t(+41", "A.B@c.De", "Ab Cd AG", "Ab GmbH", "Ab Genossenschaft", ",3008 Bern bei X", "Abweg 1,3008 Bern", "CH9300762011623852957", "756.9217.0769.85", "+41791234567", "NAT-2025-\r\n4688", "K-12345", "CHF 1", "1999-01-02", "1.2.3.4/5", ""]
    docs = fixtures.tickets(spark, "/root/testdata/sf0.001").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    pairs = [(gazetteer.groups(p), F.regexp_extract_all("text", F.lit(p), F.lit(1))) for p in gazetteer.NEEDED]
    pairs += [(T.if_any(F.col("text"), truth.NEEDED[k], detect.matches("text", p)), detect.matches("text", p)) for k, p in truth.SHAPES]
    differ, held = docs.agg(F.array(*[F.count_if(a != b) for a, b in pairs]), F.array(*[F.count_if(F.size(b) > 0) for _, b in pairs])).first()
    assert set(differ) == {0} and min(held) > 0


def test_one_match_and_many_are_told_alike(spark):
    """Against Python's search: none, one and several matches, marks in the text, characters of two units, empty and null texts."""
    odd = ["", None, "1.2.3.4", "\U0001f600 1.2.3.4", "1.2.3.4 \U0001f600 10.0.0.1/8,1.2.3.4", "\x01 1.2.3.4\x01", "\x01\x03 1.2.3.4 \x01 5.6.7.8", "x\x02\n2.2.2.2\n3.3.3.3", "a.b"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    pattern = dict(truth.SHAPES)["IP"]
    expected = {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "")] for i, t in enumerate(odd)}
    assert {r["doc_id"]: [tuple(m) for m in r["m"]] for r in docs.select("doc_id", detect.matches("text", pattern).alias("m")).collect()} == expected
    rows = truth.shaped(docs.where("text is not null")).collect()
    assert {r["doc_id"]: [(x["start"], x["end"], x["value"]) for x in r["shapes"] if x["kind"] == "IP"] for r in rows} == {i: m for i, m in expected.items() if odd[i] is not None}


def test_shapes_are_searched_once_and_lines_counted_for_who_asks(spark, capsys):
    """Spark may not infer a filter by the candidates' number, which searched all shapes once more for each mention of them."""
    docs = fixtures.tickets(spark, "/root/testdata/sf0.001")
    known = spark.createDataFrame([("Bern", "LOCATION", "strong", 102)], "literal string, kind string, tier string, ordinal int")
    entities = truth.resolved(truth.found_in(docs, known))
    for rows, counted in ((truth.candidates(docs, known), 0), (entities.select("kind", "tier"), 0), (entities.select("line"), 1)):
        capsys.readouterr()
        rows.explain()
        plan = capsys.readouterr().out
        assert plan.count("regexp_replace(") == len(truth.SHAPES) and plan.count("AS lines#") == counted


def test_documents_with_overrides_are_not_searched(spark, capsys):
    docs = spark.createDataFrame([(1, "Von: Ann Bo <ann.bo@firma.example>"), (2, "Ann Bo in 3008 Bern"), (3, "Ann Bo, 3008 Bern"), (4, None), (5, "K-12345 Ann Bo")], "doc_id long, text string")
    given_ = [(1, "PERSON", "Ann Bo", 5, 11), (1, "EMAIL", "gone", 0, 4), (2, "PERSON", "Bo Ann", 0, 6), (4, "PERSON", "x", 0, 1), (9, "PERSON", "Ann", 0, 3)]
    checked = truth.checked_overrides(docs, spark.createDataFrame([(*g, "strong", "redact") for g in given_], "doc_id long, kind string, value string, start int, end int, tier string, policy string")).persist()
    found = truth.corrected(docs, checked)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.index("MapInArrow") < plan.index("LeftAnti")  # the search is above what leaves them out
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, truth.overridden(truth.entities(docs), checked).collect()))
    # what the replaced list of document 1 vouches for counts in the others
    assert [g[0] for g in got] == [1, 3, 3, 5, 5] and got[0][1:3] == ("PERSON", "Ann Bo")
    more = truth.corrected(docs, checked.where("doc_id < 0"))
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, truth.entities(docs).select(truth.OVERRIDE).collect()))


def test_a_corpus_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert truth.entities(none).count() == 0 and gazetteer.towns(none).count() == 0


json_values = st.recursive(st.text() | st.integers() | st.booleans() | st.none(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@given(json_values)
@settings(max_examples=300, deadline=None)
def test_json_values_are_all_found_where_they_stand(value):
    def strings(v):
        return [v] if isinstance(v, str) else [s for x in (v.values() if isinstance(v, dict) else v) for s in strings(x)] if isinstance(v, (dict, list)) else []

    for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        found = jsontext.located(text)
        assert [v for _, _, v, _ in found] == strings(value)
        assert all(json.loads(f'"{text[s : s + n]}"') == v and text[s - 1] == text[s + n] == '"' for s, n, v, _ in found)


def test_json_that_is_none():
    for text in ("", "{", "[1,,2]", "{,}", '{"a" 1}', "01", "tru", '["a"] x', "'a'", '"\n"', '"\\x"', "[" * 65 + "]" * 65, "{]"):
        assert jsontext.located(text) is None, text
    assert jsontext.located('// a\n{"a": ["x", {"b": "y"}, "z",], /* c */ "d": 1.5e3,}') == [(13, 1, "x", "a"), (24, 1, "y", "a.b"), (30, 1, "z", "a")]
    assert jsontext.located("[" * 64 + "]" * 64) == []


def test_escapes_are_those_of_json_writers(spark):
    values = ['plain', 'René "B"', "a\\b\n\t\x01\x7f", "😀", ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", jsontext.escape(F.col("v")).alias("r"), jsontext.escape(F.col("v"), True).alias("a")).collect()
    assert all(r["r"] == jsontext.escaped(r["v"]) and r["a"] == jsontext.escaped(r["v"], True) for r in rows)


def test_restore_in_both_spellings_and_with_collisions(spark):
    pairs = spark.createDataFrame([("c", "h", "P", 'Zoë "Z"', "René", 1), ("c", "h", "P", "Other", "René", 2), ("c", "h", "P", "Long", "René Bauer", 3)], "client string, host string, kind string, value string, standin string, first_seen int")
    usable = vault.restorable(pairs)
    assert sorted(r["standin"] for r in usable.collect()) == ["René", "René Bauer", "René~2"]
    texts = spark.createDataFrame([("c", "h", '{"a": "Ren\\u00e9", "b": "René", "c": "René Bauer"}', "Json"), ("c", "h", "René", "Text"), ("c", "h", None, "Json"), ("x", "h", "René", "Text")], "client string, host string, text string, syntax string")
    got = [r["text"] for r in vault.restore(texts, usable, syntax="syntax").collect() if r["text"]]
    whole = next(t for t in got if t[0] == "{")
    assert json.loads(whole)["a"] in ('Zoë "Z"', "Other") and json.loads(whole)["b"] == json.loads(whole)["a"] and json.loads(whole)["c"] == "Long"
    # pairs that were not resolved do not fail the job
    assert vault.restore(texts, pairs, syntax="syntax").count() == 4


@given(st.lists(st.sampled_from(["Ann", "Anna", "nab", "é", "Ré", "x", "A", "n"]), max_size=14), st.data())
@settings(max_examples=300, deadline=None)
def test_chunked_restore_is_that_of_the_whole(words, data):
    pairs = {"Ann": "1", "Anna Ré": "2", "Ré": "3", "é é": "4"}
    text = " ".join(words)
    written = vault.spelled(pairs, False)
    whole = vault.restorer(written).sub(lambda m: written[m[0]], text)
    raw, out, work = text.encode(), "", restore.ChunkRestorer(pairs)
    while raw:
        n = data.draw(st.integers(1, len(raw)))
        out += work.feed(raw[:n])
        raw = raw[n:]
        work = restore.ChunkRestorer(pairs, False, work.pending, work.held)  # as state does between batches
    assert out + work.end() == whole


def run_stream(frame, folder, mode="append"):
    frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return frame.sparkSession.read.parquet(f"{folder}/out").collect()


def batches(spark, folder, schema, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def test_streamed_restore(spark, tmp_path):
    text = "Hallo René Bauer und Ren"
    raw = text.encode()
    schema = "stream_id string, client string, host string, syntax string, seq long, body binary, last boolean"
    parts = [[("s", "c", "h", "Text", i, raw[i * 5 : i * 5 + 5], i * 5 + 5 >= len(raw))] for i in range(-(-len(raw) // 5))]
    pairs = spark.createDataFrame([("c", "h", "René Bauer", "Zoë")], "client string, host string, standin string, value string")
    frame = restore.restored(batches(spark, tmp_path, schema, *parts), pairs)
    query = frame.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    for _ in range(120):  # time-outs wait for the clock, so the query never ends by itself
        time.sleep(0.5)
        if sum(p.numInputRows for p in query.recentProgress) >= len(parts):
            break
    query.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert "".join(r["text"] for r in sorted(rows, key=lambda r: r["seq"])) == "Hallo Zoë und Ren" and all(r["text"] for r in rows)


def test_idle_streams_are_ended():
    class State:
        exists = hasTimedOut = removed = False

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutDuration(self, ms):
            self.ms = ms

        def remove(self):
            self.removed = True

    step, state = restore.stepper(300_000), State()
    table = pd.DataFrame({"seq": [4], "body": [b"so Anna is An"], "last": [False], "syntax": ["Text"], "pairs": [[{"standin": "Anna", "value": "Eve"}, {"standin": "An", "value": "Al"}]]})
    out = pd.concat(step(("s",), iter([table]), state))
    assert out["text"].tolist() == ["so Eve is "] and state.ms == 300_000
    state.hasTimedOut = True
    out = pd.concat(step(("s",), iter([]), state))
    assert out.values.tolist() == [["s", 5, "Al"]] and state.removed


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, exchanges.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def test_lives_of_a_vault(rocks, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", t(0)), ("a", t(10)), ("b", t(5))], [("a", t(20)), ("a", t(31)), ("b", t(16))], [("a", t(41))], [("end", t(1000))]
    frame = live.lives(batches(rocks, tmp_path, "client string, at timestamp", *rows), "10 minutes", "1 minute")
    query = frame.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["client"], r["at"]): r["begun"] for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", t(0)): t(0), ("a", t(10)): t(0), ("a", t(20)): t(0), ("a", t(31)): t(31), ("a", t(41)): t(31), ("b", t(5)): t(5), ("b", t(16)): t(16), ("end", t(1000)): t(1000)}
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 2 and held[-1] == 1  # all but the last access's client are let go
    step = live.sweeper(f"{tmp_path}/clients", 10, most=2)
    for i, part in enumerate(([("a", 0), ("b", 5)], [("a", 31), ("b", 16)], [("a", 41)])):
        step(rocks.createDataFrame(part, "client string, at long"), i)
    assert [(r["client"], r["last_used"]) for r in rocks.read.parquet(f"{tmp_path}/clients/2").collect()] == [("a", 41)]


def test_exchanges_on_a_stream_are_those_of_the_batch(rocks, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    types = ["observed", "detection", "assess", "assessed", "redaction", "delivered", "completed", "responded", "unheard of"]
    rows = [(x, x * 20 + k, start + timedelta(seconds=x * 10 + rng.randint(0, 60)), rng.choice(types), float(rng.randint(0, 9))) for x in range(50) for k in range(rng.randint(1, 14))]
    sent = rows + rng.sample(rows, 80)
    sent.sort(key=lambda r: r[2] + timedelta(seconds=rng.randint(0, 50)))
    schema = "exchange_id long, event_id long, at timestamp, type string, value double"
    parts = [sent[i * len(sent) // 4 : (i + 1) * len(sent) // 4] for i in range(4)] + [[(-1, -1, datetime(2024, 1, 2), "detection", 0.0)]]
    query = exchanges.folded(batches(rocks, tmp_path, schema, *parts), "5 minutes", "2 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = [tuple(r) for r in rocks.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in exchange.folded(rocks.createDataFrame(rows, schema)).collect()}
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] == 1


def test_repeated_and_late_reports(spark, tmp_path):
    schema = "id string, at timestamp, v int"
    from datetime import datetime as d

    rows = [("a", d(2024, 1, 1, 0, 0), 1), ("b", d(2024, 1, 1, 0, 1), 2)], [("a", d(2024, 1, 1, 0, 2), 3), ("c", d(2024, 1, 1, 0, 3), 4)]
    got = run_stream(reports.once(batches(spark, tmp_path, schema, *rows), "id", "at", "1 hour"), tmp_path)
    assert sorted((r["id"], r["v"]) for r in got) == [("a", 1), ("b", 2), ("c", 4)]
    left = spark.createDataFrame([("a", d(2024, 1, 1, 0, 0)), ("b", d(2024, 1, 1, 0, 0))], "id string, at timestamp")
    late = spark.createDataFrame([("a", d(2024, 1, 1, 0, 9), 0.5), ("b", d(2024, 1, 1, 2, 0), 0.9), ("z", d(2024, 1, 1, 0, 1), 0.1)], "id string, at timestamp, risk double")
    assert {r["id"]: r["risk"] for r in reports.with_late(left, late, "id", "1 hour").collect()} == {"a": 0.5, "b": None}


def test_bodies(spark):
    plain = "né".encode() * 50
    rows = [("identity", plain, plain), ("GZIP ", gzip.compress(plain), plain), ("x-gzip", gzip.compress(plain), plain), ("deflate", zlib.compress(plain), plain), ("br", plain, None), ("gzip", b"broken", None), ("gzip", gzip.compress(plain)[:-9], None), ("gzip", gzip.compress(bytes(10**6)), None), (None, plain, plain), ("gzip", None, None)]
    out = spark.createDataFrame([(i, e, b) for i, (e, b, _) in enumerate(rows)], "i int, e string, b binary").select("i", bodies.inflated(1000)("b", "e").alias("o")).collect()
    assert {r["i"]: r["o"] and bytes(r["o"]) for r in out} == {i: x for i, (_, _, x) in enumerate(rows)}
    texts = [("text/plain; charset=iso-8859-1", "é".encode("latin-1"), "é"), ("text/plain", "é".encode(), "é"), ("a/b; charset=\"UTF-16LE\"", "é".encode("utf-16-le"), "é"), (None, b"\xff", "�"), ("x; charset=windows-1252", "é".encode(), "é"), ("x", None, None)]
    got = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(texts)], "i int, c string, b binary").select("i", bodies.decoded(F.col("b"), F.col("c")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: t for i, (_, _, t) in enumerate(texts)}


def test_corpus_files_runs_and_report(spark, tmp_path):
    for name, text in (("tickets/DOC-12 a.md", "# One\nx"), ("tickets/sub/doc-12.md", "no title"), ("free name+1.md", "t\n# Two\n"), ("skip.txt", "x")):
        at = tmp_path / "corpus" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    rows = {r["doc_id"]: (r["category"], r["title"], r["lines"]) for r in corpus.load(corpus.scan(spark, str(tmp_path / "corpus"))).collect()}
    assert rows == {"DOC-12": ("tickets", "One", 2), "DOC-12-2": ("tickets", "DOC-12-2", 1), "free-name-1": ("", "Two", 3)}
    corpus.write_run(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int"), str(tmp_path / "runs"), "t")
    corpus.write_run(spark.createDataFrame([("r3", 3)], "run_id string, n int"), str(tmp_path / "runs"), "t")
    assert spark.read.parquet(f"{tmp_path}/runs/t").count() == 3
    text = corpus.report(spark.createDataFrame([(0.5, None)], "coverage double, precision double"), spark.createDataFrame([("PERSON", 2, 1, 0, 1, 0)], "kind string, total int, replaced int, partial int, leaked int, damaged int"))
    assert "| coverage | 50.0 % |" in text and "| precision | – |" in text and "| PERSON | 2 | 1 | 0 | 1 | 0 |" in text


def test_scenarios_have_their_shares(spark):
    rows = spark.range(20_000).select(fixtures.scenario(fixtures.drawn(1, F.col("id")), fixtures.drawn(2, F.col("id")), 0.3).alias("s"))
    got = {r["s"]: r["count"] / 20_000 for r in rows.groupBy("s").count().collect()}
    for name, weight, held in fixtures.SCENARIOS:
        total = sum(w for _, w, p in fixtures.SCENARIOS if p == held)
        assert abs(got[name] - (0.3 if held else 0.7) * weight / total) < 0.015
    assert rows.repartition(7).groupBy("s").count().orderBy("s").collect() == rows.groupBy("s").count().orderBy("s").collect()


def test_posterior_is_that_of_a_long_chain():
    x = np.array([[0.9, 1, 0.3, 1.2], [0.5, 0, 0.2, -0.3], [0.4, 0, 0.1, -0.9]])

    def log_density(b):
        z = x @ b
        return -((b - risk.PRIOR_MEAN) ** 2).sum() / (2 * risk.PRIOR_SD**2) + z[0] - np.logaddexp.reduce(z)

    rng, b, out = np.random.default_rng(5), np.zeros(4), []
    at = log_density(b)
    for i in range(60_000):
        new = b + rng.normal(0, 1.2, 4)
        there = log_density(new)
        if np.log(rng.random()) < there - at:
            b, at = new, there
        if i > 5000:
            z = np.exp(x @ b - (x @ b).max())
            out.append(z / z.sum())
    assert np.abs(np.mean(out, 0) - risk.posterior(x)).max() < 0.02
    assert risk.posterior(x[:1]) == pytest.approx([1.0]) and (risk.posterior(x) == risk.posterior(x)).all()


def test_greatest_risk_and_names_not_asked_for(spark):
    risks = spark.createDataFrame([(1, "A", 0.4), (1, "B", 0.9), (1, "Z", 0.1)], "x long, name string, risk_probability double")
    tokens = spark.createDataFrame([(1, "A", "t1", 2), (1, "A", "t0", 1), (1, "B", "t2", 3)], "x long, name string, token string, ordinal int")
    known, odd = risk.placed(risks, tokens, ["x"])
    assert {r["name"]: r["token"] for r in known.collect()} == {"A": "t0", "B": "t2"} and [r["name"] for r in odd.collect()] == ["Z"]
    assert {r["x"]: r["risk"] for r in risk.greatest(risks, spark.createDataFrame([(1,), (2,)], "x long"), "x").collect()} == {1: 0.9, 2: 0.0}


def test_rules_of_awkward_requests(spark):
    r = spark.createDataFrame([(1, "notexample.com", "/x"), (2, "A.Example.com.", "/X/y"), (3, None, None), (4, "", ""), (5, "example.com", "/")], "k int, host string, path string")
    rules = spark.createDataFrame([(1, "*.example.com.", "/x")], "ordinal int, host string, prefix string")
    assert [x["k"] for x in route.blocked(r, rules, "k").collect()] == [2] and route.traced(r, rules, "k").count() == 4


def test_check_digits_of_document_numbers(spark):
    good = [("ES_NIE", "X1234567L"), ("FI_PERSONAL_IDENTITY_CODE", "131052-308T"), ("MEDICAL_LICENSE", "AB1234563"), ("IT_VAT_CODE", "IT12345678903"), ("AU_BUSINESS_NUMBER", "51 824 753 556"), ("AU_COMPANY_NUMBER", "004 085 616"), ("AU_MEDICAL_ACCOUNT_NUMBER", "2123 45670 1"), ("IN_AADHAAR", "2341 2341 2346"), ("KR_BRN", "124-81-00998"), ("TH_TNIN", "1-2345-67890-12-1"), ("UK_NHS", "943 476 5919"), ("ES_NIF", "12345678Z")]
    def wrong(v):
        i = max(i for i, c in enumerate(v[:-1]) if c.isdigit())
        return v[:i] + str((int(v[i]) + 1) % 10) + v[i + 1 :]

    docs = spark.createDataFrame([(2 * i + k, t) for i, (_, v) in enumerate(good) for k, t in ((0, v), (1, wrong(v)))], "doc_id long, text string")
    from veilwork.functions import detect

    found = {(r["doc_id"], r["kind"]): r["score"] for r in detect.findings(docs, [k for k, _ in good]).collect()}
    assert all(found[2 * i, k] >= 0.6 for i, (k, _) in enumerate(good)), found
    assert all(found[2 * i + 1, k] < 0.6 for i, (k, _) in enumerate(good)), found


def test_risks_of_groups_across_batches(spark):
    """Groups of one to four names, cut by batches of three rows: each name's risk is that of its group alone."""
    rng = np.random.default_rng(2)
    rows = [(g, k, f"n{k}", *map(float, rng.normal(size=4))) for g in range(40) for k in range(1 + g % 4)]
    df = spark.createDataFrame(rows, "g long, ordinal int, name string, similarity double, contained double, ratio double, standing double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = {(r["g"], r["name"]): r["risk_probability"] for r in risk.assessed(df, "g").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in range(40):
        expected = risk.posterior(np.array([r[3:] for r in rows if r[0] == g]))
        assert np.allclose([got[g, f"n{k}"] for k in range(1 + g % 4)], expected)
    assert len(got) == len(rows) and risk.assessed(df.limit(0), "g").collect() == []


def test_risks_and_bodies_are_worked_out_by_many_tasks(spark):
    """Both tables are small: neither may end in the one task that reads their file, or that Spark joins small shuffles to."""
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(traffic.risk_check(spark, "/root/testdata/sf0.001")) > 1
    assert tasks(traffic.json_string_values(spark, "/root/testdata/sf0.001")) > 1
