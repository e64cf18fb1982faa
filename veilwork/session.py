"""Session defaults and table loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark: SparkSession) -> int:
    """A number of tasks that keeps all cores at work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all tasks that can run: for narrow rows that much is made of, as their file is too small to be read by many
    tasks. A given number, as Spark would join small partitions again."""
    return df.repartition(tasks(df.sparkSession))


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once for all its uses: a table in spark.checkpoint.dir where that is set, else persisted (Spark works lost
    parts out again). For tables that several later steps read."""
    at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.persist()
    path = f"{at}/veilwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
