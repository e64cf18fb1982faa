"""Re-identification risk: how far a text still points at each of the names taken out of it.

Features of a (text, name) pair are the similarity of their embeddings, whether the text holds the name, the similarity of the
strings, and the standing of the similarity among the text's names. The posterior is that of a softmax over a text's names
whose weights are normal a priori, with the first name as the one observed: its mean comes from importance sampling with fixed
draws, so it is the same on any run and needs no chains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilwork.functions import text as T
from veilwork.session import tasks

# The prior of the weights
PRIOR_MEAN, PRIOR_SD = 0.5, 2.0
DRAWS, SEED = 20_000, 20_240_817
FEATURES = ["similarity", "contained", "ratio", "standing"]


def features(pairs: DataFrame, group: str) -> DataFrame:
    """pairs (group, ordinal, text, name, similarity) with contained, ratio and standing. Group figures are aggregated and joined
    back: no task holds a group."""
    spread = pairs.groupBy(group).agg(F.avg("similarity").alias("_mean"), F.stddev_pop("similarity").alias("_sd"))
    rows = pairs.join(spread, group)
    standing = F.when(F.col("_sd") > 0, (F.col("similarity") - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return rows.select(*pairs.columns, T.contains_folded(F.col("text"), F.col("name")).cast("double").alias("contained"), T.levenshtein_ratio(F.col("text"), F.col("name")).alias("ratio"), standing.alias("standing"))


@cache
def draws(n: int) -> np.ndarray:
    """The weights drawn for n features, a row a feature: the same in each worker, drawn once."""
    return np.ascontiguousarray(np.random.default_rng(SEED).normal(PRIOR_MEAN, PRIOR_SD, (DRAWS, n)).T)


def posterior(x: np.ndarray) -> np.ndarray:
    """The mean probability of each row of x (names by features), given that the first is the one."""
    # names by draws: names are few, so a draw's sums go down whole rows
    p = x @ draws(x.shape[1])
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p @ p[0] / p[0].sum()


def assessed(featured: DataFrame, group: str) -> DataFrame:
    """group, name, risk_probability. Rows come sorted by group, many groups a batch; a text's names are few, and only those of one text
    are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            table = pa.Table.from_batches([x for x in (held, b) if x is not None]).combine_chunks() if held is not None or b is not None else None
            if table is None or not len(table):
                continue
            rows = table.to_batches()[0]
            keys = rows.column(0).to_pylist()
            x = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in FEATURES], 1)
            # groups begin where the key is not that of the row before; the last one may go on in the next batch
            begins = [0, *(i for i in range(1, len(rows)) if keys[i] != keys[i - 1])]
            whole = len(rows) if b is None else begins[-1]
            held = None if b is None else rows.slice(whole)
            ends = [*begins[1:], len(rows)]
            risks = [posterior(x[i:j]) for i, j in zip(begins, ends) if j <= whole]
            if risks:
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(0, whole), rows.column("name").slice(0, whole), pa.array(np.concatenate(risks))], names=[group, "name", "risk_probability"])

    # rows are narrow and their work is not: a given number of tasks, as Spark would join small ones; by a hash of the group, as
    # Spark would leave out a shuffle by the group itself after a join on it
    rows = featured.select(group, "name", "ordinal", *FEATURES).repartition(tasks(featured.sparkSession), F.xxhash64(group)).sortWithinPartitions(group, "ordinal")
    return rows.mapInArrow(run, f"{group} {dict(featured.dtypes)[group]}, name string, risk_probability double")


def greatest(risks: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """group and risk for each text: its names' greatest probability, 0 if it has none."""
    most = risks.groupBy(group).agg(F.max("risk_probability").alias("risk"))
    return texts.select(group).join(most, group, "left").select(group, F.coalesce("risk", F.lit(0.0)).alias("risk"))


def placed(risks: DataFrame, tokens: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Risks with the token of their name (the first found, by ordinal), and those whose name was not asked for."""
    first = tokens.groupBy(*key, "name").agg(F.min_by("token", "ordinal").alias("token"))
    return risks.join(first, [*key, "name"]), risks.join(first, [*key, "name"], "left_anti")
