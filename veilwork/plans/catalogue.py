"""The query catalogue: each key's DataFrame query and its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.plans import bodies, evaluation, exact, privacy, relational, traffic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | privacy.QUERIES | evaluation.QUERIES | traffic.QUERIES | bodies.QUERIES | exact.QUERIES
ORACLE: dict[str, str] = relational.ORACLE | privacy.ORACLE | evaluation.ORACLE | traffic.ORACLE | bodies.ORACLE | exact.ORACLE
flagship = privacy.flagship
