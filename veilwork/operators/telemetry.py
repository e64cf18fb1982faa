"""Telemetry: events of requests and exchanges, checked, encoded, and folded into views.

An event row has event_id, at (epoch milliseconds), type, request_id, exchange_id, client_label and a struct or columns of its own.
All folds are keyed aggregates with an explicit order, so they do not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The stages of an exchange in order
STAGES = ("ingress", "detect", "redact", "upstream", "restore", "done")


def verdict(raw: Column, schema: str, rules: Column) -> Column:
    """Why a raw frame does not count: not-text, not-json, not-an-object or invalid (by the rules over ``parsed``), else ok."""
    return F.when(raw.isNull(), "not-text").when(F.try_parse_json(raw).isNull(), "not-json").when(F.schema_of_variant(F.try_parse_json(raw)).rlike("^OBJECT"), F.when(F.coalesce(rules, F.lit(False)), "ok").otherwise("invalid")).otherwise("not-an-object")


def encoded(kind: Column, *fields: Column) -> Column:
    """An event as JSON: its type first, names as given (camelCase), nulls left out."""
    return F.to_json(F.struct(kind.alias("type"), *fields))


def rollup(observed: DataFrame, completed: DataFrame, key: str = "request_id") -> DataFrame:
    """Observed requests with the completion of theirs, if any; of repeated reports, the first of each counts."""
    one = lambda df: df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct("at", "event_id")).alias("x"))
    return one(observed).select(key, F.col("x").alias("seen")).join(one(completed).select(key, F.col("x").alias("done")), key, "left")


def stages(events: DataFrame, stage: Column, key: str) -> DataFrame:
    """key and the furthest stage its events reached; late verdicts (null stage) do not move it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return events.where(stage.isNotNull()).groupBy(key).agg(F.max_by(stage, rank).alias("stage"))


def patched(exchanges: DataFrame, late: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """exchanges with the fields of late reports (the last of each), and the reports of unknown exchanges: these change nothing."""
    fields = [c for c in late.columns if c not in (key, "at")]
    last = late.groupBy(key).agg(F.max_by(F.struct(*fields), "at").alias("_x"))
    return exchanges.join(last, key, "left").select(*exchanges.columns, *[F.col(f"_x.{c}").alias(c) for c in fields]), late.join(exchanges.select(key), key, "left_anti")


def devices(requests: DataFrame, exchanges: DataFrame) -> DataFrame:
    """By client_label: seen, treated, identifiers, max_risk, last_seen_at."""
    found = exchanges.groupBy("client_label").agg(F.sum("n_entities").alias("identifiers"), F.max("risk").alias("max_risk"))
    seen = requests.groupBy("client_label").agg(F.count("*").alias("seen"), F.count_if(F.col("treatment") == "treated").alias("treated"), F.max("at").alias("last_seen_at"))
    return seen.join(found, "client_label", "left").select("client_label", "seen", "treated", F.coalesce("identifiers", F.lit(0)).alias("identifiers"), F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"), "last_seen_at")


def counters(requests: DataFrame, exchanges: DataFrame) -> DataFrame:
    """One row: requests, treated, identifiers_held, blocks."""
    return requests.agg(F.count("*").alias("requests"), F.count_if(F.col("treatment") == "treated").alias("treated"), F.count_if(F.col("treatment") == "block").alias("blocks")).crossJoin(exchanges.agg(F.coalesce(F.sum("n_entities"), F.lit(0)).alias("identifiers_held")))


def newest(rows: DataFrame, most: int, at: str = "at", tie: str = "event_id") -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(most)


# Rows of the traffic views
TRAFFIC, TREATED_TRAFFIC = 140, 1000


def traffic(rows: DataFrame, treated_only: bool = False) -> DataFrame:
    """The newest rows of the traffic, or the newest treated ones, of which more are kept."""
    return newest(rows.where("treatment = 'treated'"), TREATED_TRAFFIC) if treated_only else newest(rows, TRAFFIC)


def unseen(exchanges: DataFrame, shown: DataFrame, retired: DataFrame, key: str = "exchange_id") -> DataFrame:
    """exchanges that are neither shown nor retired (tables with the key), in no order; those without a key are unseen."""
    return exchanges.join(shown.select(key).union(retired.select(key)).distinct(), key, "left_anti")


def since(rows: DataFrame, seq: int, column: str = "event_id") -> DataFrame:
    """Rows after seq, oldest first."""
    return rows.where(F.col(column) > seq).orderBy(column)


def trailing(value: str, key: str, most: int, *order: str) -> Column:
    """Mean of a key's last ``most`` values, the row's own included."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - most, 0))


def numbered(rows: DataFrame, prefix: str, key: str, *order: str) -> DataFrame:
    """rows and id: prefix and a number of five digits that grows in order within the key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 5, "0")))


def dropped(queued: DataFrame, report: Column) -> DataFrame:
    """report and n: how many events were dropped since the report before it; reports without drops go."""
    return queued.where(F.col("dropped")).groupBy(report.alias("report")).agg(F.count("*").alias("n"))
