"""Exchanges as state with timers: the same rows as ``operators.exchange.folded``, once the time has come.

An exchange's reports wait as state until none has come for ``quiet`` of event time; then the watermark fires its timer, the reports are
folded in order of time, one row goes out, and the state ends. So late, shuffled and repeated reports within the watermark's delay
change nothing, and nothing is kept of an exchange that never completes. The state is in RocksDB, not in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from veilwork.operators import exchange
from veilwork.operators.telemetry import STAGES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = [f.split()[0] for f in exchange.FIELDS.split(", ")]


def machine(reports: list[tuple]) -> tuple | None:
    """What the reports (at in ms, event_id, type, value) of one exchange say, in the order of FIELDS; None if it was not observed."""
    opened = done = verdict = None
    stage, counted, ignored, found, restored, busy, running = 0, 0, 0, 0.0, 0.0, 0, False
    for at, _, kind, value in sorted({r[1]: r for r in reports}.values(), key=lambda r: r[:2]):
        if opened is None and kind == "observed":
            opened = at
        elif opened is None or kind == "observed" or (done is not None and kind != "assessed"):
            ignored += 1
            continue
        counted += 1
        stage = max(stage, STAGES.index(exchange.SHOWS[kind]) + 1 if kind in exchange.SHOWS else 0)
        if kind == "completed":
            done = at
        elif kind == "detection":
            found = max(found, value)
        elif kind == "delivered":
            restored = max(restored, value)
        elif kind == "assess":
            busy, running = busy + running, True
        elif kind == "assessed":
            verdict, running = value, False
    time = lambda ms: None if ms is None else pd.Timestamp(ms, unit="ms")
    return opened is not None and (time(opened), time(done), STAGES[stage - 1], counted, ignored, found, restored, verdict, busy) or None


class Exchanges(StatefulProcessor):
    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reports = handle.getListState("reports", "at long, event_id long, type string, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at.timestamp() * 1000), int(r.event_id), r.type, float(r.value)) for table in rows for r in table.itertuples()]
        before = list(self.handle.listTimers())
        for timer in before:
            self.handle.deleteTimer(timer)
        self.reports.appendList(new)
        self.handle.registerTimer(max([r[0] + self.quiet_ms for r in new] + before))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = machine(list(self.reports.get()))
        self.reports.clear()
        yield pd.DataFrame([(key[0], *row)] if row else [], columns=COLUMNS)


def folded(reports: DataFrame, quiet: str, delay: str) -> DataFrame:
    """FIELDS for each exchange, when no report of it has come for ``quiet``; reports may be ``delay`` late. The session needs PROVIDER as
    spark.sql.streaming.stateStore.providerClass."""
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = reports.select("exchange_id", "event_id", "at", "type", "value").withWatermark("at", delay)
    return rows.groupBy("exchange_id").transformWithStateInPandas(Exchanges(ms), exchange.FIELDS, "append", "EventTime")
