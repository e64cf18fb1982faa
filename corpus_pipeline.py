"""The corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, source mixing, BPE.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows that the one before it kept. All but the last
return the columns of documents; the mix repeats a document that it takes twice.

Cases: null and empty texts have no 50 words, so the first stage rejects them, and the third drops what its cuts leave empty; rows
with null or repeated ids are rows like others: near copies among them are one group, of which one row stays, and passages are
not cut between equal ids; null sources are one source; ties are broken by hashes of the row, alike on each run; an empty table
gives empty tables; extra columns, of any name, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import bpe, common, jaccard, mixing, queries, repeats, rules

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Repeated passages: bytes. Shorter ones are turns of phrase, dates and the like.
PASSAGE = 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test or the learned decision list rejects go."""
    return rules.keep(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut from the text; documents without text, null or empty, go."""
    return repeats.without(docs, PASSAGE).where("text != ''")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document of the mix."""
    return bpe.round_trip(docs, queries.tokenizer())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]

#: The quality rules are learned, which SQL cannot express; tests hold the operators, and the stages' work on a fixture, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
