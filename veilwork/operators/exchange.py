"""Exchanges as state machines: what a set of reports says of each, in whatever order they came.

A report has exchange_id, event_id, at (timestamp), type and value. Of an exchange's reports, repeated ones (by event_id) count once, and
the rest by time: the first ``observed`` opens it, what is before that is of an unknown exchange and changes nothing; the first ``completed``
after that ends it, and later reports are ignored, but for an assessment's verdict, which may come late. Assessments run one at a time: an
``assess`` while another has no ``assessed`` yet is skipped as busy.

``folded`` does this by keyed aggregates and one window over an exchange's assessments; ``streaming.exchange`` by state and timers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilwork.operators.telemetry import STAGES

# The stage that each type of report shows
SHOWS = {"observed": "ingress", "opened": "ingress", "detection": "detect", "redaction": "redact", "dispatched": "upstream", "responded": "upstream", "rehydration": "restore", "delivered": "restore", "completed": "done"}
FIELDS = "exchange_id long, opened_at timestamp, done_at timestamp, stage string, reports long, ignored long, found double, restored double, verdict double, busy long"


def rank(type_: Column) -> Column:
    """The number of the stage that a report shows, from 1; null if none."""
    out = None
    for kind, stage in SHOWS.items():
        out = F.when(type_ == kind, STAGES.index(stage) + 1) if out is None else out.when(type_ == kind, STAGES.index(stage) + 1)
    return out


def folded(reports: DataFrame) -> DataFrame:
    """A row for each exchange that was observed: FIELDS. Exchanges without an ``observed`` have none."""
    rows = reports.dropDuplicates(["exchange_id", "event_id"]).select("exchange_id", "type", "value", F.struct("at", "event_id").alias("when"))
    opened = rows.where("type = 'observed'").groupBy("exchange_id").agg(F.min("when").alias("opened"))
    rows = rows.join(opened, "exchange_id")
    done = rows.where((F.col("type") == "completed") & (F.col("when") > F.col("opened"))).groupBy("exchange_id").agg(F.min("when").alias("done"))
    rows = rows.join(done, "exchange_id", "left")
    assessing = F.col("type").isin("assess", "assessed")
    inside = (F.col("when") >= F.col("opened")) & (F.col("done").isNull() | (F.col("when") <= F.col("done")))
    verdict = (F.col("type") == "assessed") & (F.col("when") > F.col("opened"))
    counts = inside & ~((F.col("type") == "observed") & (F.col("when") > F.col("opened"))) | verdict
    rows = rows.withColumn("counts", counts)
    before = F.lag("type").over(Window.partitionBy("exchange_id", assessing & F.col("counts")).orderBy("when"))
    rows = rows.withColumn("busy", F.col("counts") & (F.col("type") == "assess") & F.coalesce(before == "assess", F.lit(False)))
    of = lambda kind, c="value": F.when(F.col("counts") & (F.col("type") == kind), F.col(c))
    return rows.groupBy("exchange_id").agg(
        F.min("opened.at").alias("opened_at"), F.min("done.at").alias("done_at"), F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.max(F.when(F.col("counts"), rank(F.col("type"))))).alias("stage"),
        F.count_if("counts").alias("reports"), F.count_if(~F.col("counts")).alias("ignored"), F.coalesce(F.max(of("detection")), F.lit(0.0)).alias("found"), F.coalesce(F.max(of("delivered")), F.lit(0.0)).alias("restored"),
        F.max_by(of("assessed"), of("assessed", "when")).alias("verdict"), F.count_if("busy").alias("busy"),
    )
