"""One query for each training-data operator, with its contract's columns; SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm import bpe, chat, common, jaccard, manifest, mixing, negatives, pages, phrases, repeats, rules, simhash, toxicity, urls


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.read(spark, sf_dir, "documents"), tokenizer())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes_of(common.read(spark, sf_dir, "documents"), n=3, percent=90)


#: The rules that the contract gives: verdict, host, path.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(common.read(spark, sf_dir, "pages"), given)


OP4_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(common.read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Thresholds found in one go: the sum of words in order of hash, up to the document that passes the source's budget.
OP5_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS bigint) AS size, md5(coalesce(CAST(doc_id AS varchar), '') || ':' || coalesce(text, '')) AS hash FROM documents),
w AS (SELECT source, CAST(sum(size) AS double) AS total, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS double) AS weight FROM d GROUP BY source),
l AS (SELECT *, 2 * total AS cap, (1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY 2 * total / weight, source IS NOT NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, total, least(cap, max(level) OVER () * weight) AS target FROM l),
s AS (SELECT *, CASE WHEN target >= total THEN 1 ELSE 0 END AS copies, target - CASE WHEN target >= total THEN total ELSE 0 END AS budget FROM t),
h AS (SELECT source, hash, CAST(sum(size) AS double) AS words FROM d GROUP BY source, hash),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto, lead(hash) OVER (PARTITION BY source ORDER BY hash) IS NULL AS last FROM h),
e AS (SELECT s.source, s.total, s.target, s.copies, c.hash AS edge, 2 * (s.budget - c.upto + c.words) >= c.words AS whole FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source
  WHERE c.upto > s.budget AND c.upto - c.words <= s.budget OR c.last AND c.upto <= s.budget)
SELECT d.doc_id, d.size, CAST(e.total AS bigint) AS source_size, e.target, CAST(d.size * (e.copies + CASE WHEN d.hash < e.edge OR d.hash = e.edge AND e.whole THEN 1 ELSE 0 END) AS bigint) AS taken FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(common.read(spark, sf_dir, "documents"), length=50)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    trained = toxicity.in_training(F.col("doc_id"))
    model = toxicity.learn(docs.where(trained), labels.where(trained))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", F.coalesce(~trained, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select bigint(-1) conv_id, bigint(i) turn, if(i = 0, 'user', 'assistant') role, '{hard}' text from range(2) t(i)")
    back = chat.read_back(chat.chats(turns.unionByName(more)))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text))),
p AS (SELECT *, regexp_replace(role, '<(\|+)', '<\1|', 'g') AS safe_role, regexp_replace(text, '<(\|+)', '<\1|', 'g') AS safe FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(11 + sum(length(safe) + CASE WHEN before IS NULL THEN 22 + length(safe_role) WHEN before = role THEN 11 ELSE 33 + length(safe_role) END) AS bigint) AS formatted_chars
FROM p GROUP BY conv_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", common.text_of().alias("text"))
    rows = simhash.with_next(simhash.with_fingerprint(docs, "text", "fp"), ["text", "fp"])
    third = "cast(floor(length(text) / 3) as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, length(text) - {third}), left(next_text, {third}))"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "fp", "next_fp")
    rows = simhash.with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), simhash.hexed("fp").alias("fingerprint"), simhash.hexed("edited_fp").alias("edited_fingerprint"),
        simhash.likeness("fp", "edited_fp").alias("near_edited"), simhash.likeness("fp", "next_fp").alias("near_next"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phrases.contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows as texts, joined to the documents' runs of as many words.
OP11_SQL = """
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
t AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS run FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 8, 2))) AS s FROM b WHERE len(words) > 0)),
r AS (SELECT row, n, s, array_to_string(words[s:s + n - 1], ' ') AS run FROM (SELECT row, words, n, unnest(range(1, CAST(len(words) - n + 2 AS bigint))) AS s FROM w, (SELECT DISTINCT n FROM t) WHERE len(words) >= n)),
h AS (SELECT row, item_id, s, r.n FROM r JOIN t ON r.n = t.n AND r.run = t.run),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM h) GROUP BY row),
i AS (SELECT row, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS varchar))) AS items FROM h GROUP BY row)
SELECT doc_id, CAST(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (row) LEFT JOIN i USING (row)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.taking_part(common.read(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS bigint) AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label = own),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.n ORDER BY s.score DESC, s.vec_id) AS int) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.n <= 5)
SELECT * FROM n WHERE rank <= 5
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(manifest.manifest(common.read(spark, sf_dir, "documents")))


#: Trees by recursion over levels; a proof is folded by recursion over the levels of its own source, then of the sources.
OP13_SQL = """
WITH RECURSIVE
field AS (SELECT doc_id, source, text, concat(
    CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS varchar))) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS varchar))) || ':' || n_chars END) AS head FROM documents),
crc_table AS (SELECT i, list_reduce(list_prepend(CAST(i AS bigint), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crcs AS (SELECT list(v ORDER BY i) AS l FROM crc_table),
hashed AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS other,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS bigint) FOR c IN regexp_extract_all(CAST(doc_id AS varchar), '.')]), lambda h, c: xor(h >> 8, l[CAST((xor(h, c) & 255) + 1 AS bigint)]))) % 5 = 0, false) AS tampered
  FROM field, crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY source) AS size FROM hashed),
up AS (SELECT 0 AS level, source, nth AS pos, leaf AS digest, size AS n FROM placed
  UNION ALL SELECT any_value(level) + 1, source, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, pos // 16),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS nth, count(*) OVER () AS n FROM up WHERE n = 1),
over_ AS (SELECT 0 AS level, nth AS pos, subroot AS digest, n FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + 15) // 16 FROM over_ WHERE n > 1 GROUP BY pos // 16),
families AS (SELECT level, source, pos // 16 AS parent, list(digest ORDER BY pos) AS l FROM up WHERE n > 1 GROUP BY level, source, pos // 16),
over_families AS (SELECT level, pos // 16 AS parent, list(digest ORDER BY pos) AS l FROM over_ WHERE n > 1 GROUP BY level, pos // 16),
climb AS (SELECT doc_id, source, leaf, nth AS row, 0 AS level, nth AS pos, CASE WHEN tampered THEN other ELSE leaf END AS digest, '' AS proof FROM placed
  UNION ALL SELECT c.doc_id, c.source, c.leaf, c.row, c.level + 1, c.pos // 16,
    sha256(array_to_string(l[:c.pos % 16], '') || c.digest || array_to_string(l[c.pos % 16 + 2:], '')), c.proof || array_to_string(l[:c.pos % 16], '') || array_to_string(l[c.pos % 16 + 2:], '')
  FROM climb c JOIN families f ON c.level = f.level AND c.source IS NOT DISTINCT FROM f.source AND c.pos // 16 = f.parent),
tops AS (SELECT c.* FROM climb c JOIN (SELECT source, max(level) AS level FROM up GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source AND c.level = h.level),
onward AS (SELECT t.doc_id, t.source, t.leaf, t.row, s.subroot, 0 AS level, s.nth AS pos, t.digest, t.proof FROM tops t JOIN subroots s ON t.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT c.doc_id, c.source, c.leaf, c.row, c.subroot, c.level + 1, c.pos // 16,
    sha256(array_to_string(l[:c.pos % 16], '') || c.digest || array_to_string(l[c.pos % 16 + 2:], '')), c.proof || array_to_string(l[:c.pos % 16], '') || array_to_string(l[c.pos % 16 + 2:], '')
  FROM onward c JOIN over_families f ON c.level = f.level AND c.pos // 16 = f.parent)
SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root, o.digest = r.digest AS verified
FROM onward o, (SELECT digest FROM over_ WHERE n = 1) r WHERE o.level = (SELECT max(level) FROM over_)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_page_diff, op2_bpe, op3_ngram_jaccard, op4_url_filter, op5_source_mix, op6_suffix_dedup, op7_toxicity, op8_chat_format, op9_quality_rules, op10_simhash, op11_decontaminate, op12_hard_negatives, op13_merkle_manifest)}
ORACLE: dict[str, str] = {"op4_url_filter": OP4_SQL, "op5_source_mix": OP5_SQL, "op8_chat_format": OP8_SQL, "op11_decontaminate": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
