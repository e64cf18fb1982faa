import random
import re
from hashlib import sha256

import corpus_pipeline
from veilwork.llm import common


def test_stages_keep_the_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.read(spark, sf, "documents")
    columns, names = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf))
        assert docs.columns == columns, name
        names.append((name, docs.count()))
    assert names[0][1] < common.read(spark, sf, "documents").count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_against_brute_force_on_awkward_rows(spark):
    """One row of each group of near copies stays, and passages of a smaller id are cut, byte by byte."""
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base, passage = text(80), text(40)
    rows = [(1, base), (2, base + " more"), (None, base), (3, text(70) + " " + passage), (4, passage + " " + text(60)), (5, text(66)), (5, text(90)), (None, text(75)), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, node int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["node"] for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    cut = {r["node"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, kept, "").collect()}
    n, first = corpus_pipeline.PASSAGE, rows[3][1].encode()
    held = {first[k : k + n] for k in range(len(first) - n + 1)}
    data = rows[4][1].encode()
    gone = {j for k in range(len(data) - n + 1) if data[k : k + n] in held for j in range(k, k + n)}
    assert cut == {k: rows[k][1] for k in (0, 3, 5, 6, 7)} | {4: bytes(b for j, b in enumerate(data) if j not in gone).decode()}
    mixed = corpus_pipeline.source_mix(spark, spark.createDataFrame([(k, t, "en", "s", 0, k) for k, t in cut.items()], docs.schema), "")
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    total = sum(size(t) for t in cut.values())
    assert abs(sum(size(r["text"]) for r in mixed.collect()) - 1.5 * total) <= max(map(size, cut.values()))
    out = {(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.tokens(spark, mixed, "").collect()}
    assert out == {(r["doc_id"], sha256(r["text"].encode()).hexdigest()) for r in mixed.collect()}
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("1 = 0"), "").count() == 0
