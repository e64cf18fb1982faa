"""Queries whose plan is plain SQL, the same for Spark and the oracle. ``{table}`` stands for a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.session import load

#: Events as traffic: who, what was done with the exchange, how long it took.
EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, CASE event_type WHEN 'purchase' THEN 'treated' WHEN 'view' THEN 'passthrough' WHEN 'error' THEN 'block' ELSE 'clean' END AS treatment FROM {events})"
#: Documents judged: a toxic label is a leak, a bad quality damage.
JUDGED = "j AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id)"

SQL = {
    # sources and predicates
    "doc_profile": "SELECT doc_id, lang, source, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM {documents}",
    # joins
    "names_intersect": "SELECT replace(lower(c_name), 'customer#', '') AS name FROM {customer} INTERSECT SELECT replace(lower(s_name), 'supplier#', '') FROM {supplier}",
    # aggregations
    "harness_totals": f"WITH {EV} SELECT treatment, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY GROUPING SETS ((treatment), (treatment, event_type), ())",
    # windows
    "trailing_latency": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9) AS trailing FROM {events}",
    "exchange_timeline": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events}",
    "exchange_retention": f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN treatment = 'treated' THEN 1 ELSE 0 END, ts DESC, event_id DESC) AS i FROM ev) SELECT user_id, event_id, treatment FROM r WHERE i <= 20",
    "coalesce_islands": """WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS starts FROM {events}), g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT user_id, CAST(island AS bigint) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY user_id, island""",
    "segment_offsets": "SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS offset_, length(text) AS size FROM {conversations}",
    "bounded_queue": "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}) SELECT user_id, CAST(sum(CASE WHEN i <= 32 THEN 1 ELSE 0 END) AS bigint) AS queued, CAST(sum(CASE WHEN i > 32 THEN 1 ELSE 0 END) AS bigint) AS dropped FROM r GROUP BY user_id",
    # top-k: each task sends its best rows only
    "traffic_retention": f"WITH {EV}, newest AS (SELECT event_id, treatment FROM ev ORDER BY ts DESC, event_id DESC LIMIT 140), kept AS (SELECT event_id, treatment FROM ev WHERE treatment = 'treated' ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT event_id, treatment FROM newest UNION SELECT event_id, treatment FROM kept",
    "lru_vault": "SELECT user_id AS client, max(event_id) AS last_used FROM {events} GROUP BY user_id ORDER BY max(event_id) DESC LIMIT 64",
    "kind_frequency_topk": "SELECT event_type AS kind, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, kind LIMIT 3",
    "rule_order_topk": "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC, s_suppkey LIMIT 200",
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = {*re.findall(r"(?<!\{)\{(\w+)\}", sql)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables})

    return run


QUERIES = {name: _query(sql) for name, sql in SQL.items()}
ORACLE = {name: re.sub(r"(?<!\{)\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}") for name, sql in SQL.items()}
