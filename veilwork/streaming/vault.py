"""The vault as state: lives of a client's map, ended by a time without use, and a bound on the number of clients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veilwork.operators import vault

SWEEP = "5 minutes"


class Lives(StatefulProcessor):
    """Keeps when a client's map began and was last used, and lets go of it when it has not been used for the time to live."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getValueState("map", "begun long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        begun, last = self.map.get() or (None, None)
        out = []
        for at in sorted(int(x.timestamp() * 1000) for table in rows for x in table["at"]):
            if last is None or at - last > self.ttl_ms:
                begun = at
            last = max(at, last or at)
            out.append((key[0], pd.Timestamp(at, unit="ms"), pd.Timestamp(begun, unit="ms")))
        self.map.update((begun, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl_ms + 1)
        yield pd.DataFrame(out, columns=["client", "at", "begun"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.map.clear()
        yield pd.DataFrame([], columns=["client", "at", "begun"])


def lives(accesses: DataFrame, ttl: str, delay: str) -> DataFrame:
    """client, at, begun for each access (client, at: timestamps): the map lives on while accesses are no further apart than the time to
    live, and begins anew after that. Accesses may be ``delay`` late; those of one batch are taken in order of time. An event-time timer
    ends the state of a client that is not used any more. The session needs ``exchange.PROVIDER``."""
    rows = accesses.select("client", "at").withWatermark("at", delay)
    return rows.groupBy("client").transformWithStateInPandas(Lives(int(pd.Timedelta(ttl).total_seconds() * 1000)), "client string, at timestamp, begun timestamp", "append", "EventTime")


def swept(clients: DataFrame, now_ms: int, ttl_ms: int, most: int = vault.CLIENTS) -> DataFrame:
    """The clients (client, last_used in ms) that a sweep leaves: not expired, and of these the ones used last."""
    return vault.least_recent(clients.where(now_ms - F.col("last_used") <= ttl_ms), most)


def sweeper(table: str, ttl_ms: int, most: int = vault.CLIENTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, with a trigger of SWEEP: merges a batch's accesses (client, at) into the table of clients and sweeps it. The
    bound on clients is no state of one key, so it is a step of its own."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        used = batch.groupBy("client").agg(F.max("at").alias("last_used"))
        before = spark.read.parquet(f"{table}/{number - 1}") if number else used.where("false")
        now = used.agg(F.max("last_used")).first()[0]
        merged = before.unionByName(used).groupBy("client").agg(F.max("last_used").alias("last_used"))
        swept(merged, now if now is not None else 0, ttl_ms, most).write.mode("overwrite").parquet(f"{table}/{number}")

    return run
