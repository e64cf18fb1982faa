"""Restoring stand-ins in bodies that arrive in chunks: the same text as a restore of the whole body, whatever the chunks.

State by stream: the bytes of a character that is not complete, the end of the text that may still become a stand-in, and what an
end of the stream would make of both. A stream that sends nothing for IDLE is taken as ended, so no state stays for ever.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilwork.operators import vault


IDLE = "10 minutes"


class ChunkRestorer:
    """feed(bytes) gives the text that no later chunk can change; end() gives the rest."""

    def __init__(self, pairs: dict[str, str], as_json: bool = False, pending: bytes = b"", held: str = "") -> None:
        self.pairs = vault.spelled({s: v for s, v in pairs.items() if s}, as_json)
        self.look = vault.restorer(self.pairs) if self.pairs else None
        self.starts = {s[:n] for s in self.pairs for n in range(1, len(s))}
        self.longest = max(map(len, self.pairs), default=1) - 1
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.decoder.setstate((pending, 0))
        self.held = held

    @property
    def pending(self) -> bytes:
        return self.decoder.getstate()[0]

    def _settle(self, text: str, last: bool) -> str:
        if not self.look:
            self.held = ""
            return text
        # from here on a stand-in may begin that the next chunk ends
        safe = len(text) if last else next((len(text) - n for n in range(min(self.longest, len(text)), 0, -1) if text[-n:] in self.starts), len(text))
        out, at = [], 0
        for m in self.look.finditer(text):
            if m.start() >= safe:
                break
            out += text[at : m.start()], self.pairs[m[0]]
            at = m.end()
        out.append(text[at : max(at, safe)])
        self.held = text[max(at, safe) :]
        return "".join(out)

    def feed(self, chunk: bytes) -> str:
        return self._settle(self.held + self.decoder.decode(chunk), False)

    def end(self) -> str:
        return self._settle(self.held + self.decoder.decode(b"", True), True)


def stepper(idle_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a stream's chunks of one batch, or its time-out, give."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, held, tail, seq = state.get if state.exists else (b"", "", "", -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], seq + 1, tail)] if tail else [], columns=["stream_id", "seq", "text"])
            return
        table = pd.concat(list(frames)).sort_values("seq")
        found = table["pairs"].iloc[0]
        work = ChunkRestorer({p["standin"]: p["value"] for p in found} if found is not None else {}, table["syntax"].iloc[0] == "Json", pending, held)
        out = []
        for r in table.itertuples():
            text = work.feed(bytes(r.body or b"")) + (work.end() if r.last else "")
            if text:
                out.append((key[0], r.seq, text))
        if table["last"].any():
            state.remove()
        else:
            pending, held = work.pending, work.held
            state.update((pending, held, work.end(), int(table["seq"].max())))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return step


def restored(chunks: DataFrame, pairs: DataFrame, idle: str = IDLE) -> DataFrame:
    """stream_id, seq, text for each chunk (stream_id, client, host, syntax, seq, body, last) of a stream; rows without text go,
    as an empty one would mean the end. pairs is a static table (client, host, standin, value), from ``vault.restorable``. What is held
    back of a stream that stays idle comes as one more chunk. As time-outs wait for the clock, the query runs until it is stopped."""
    maps = pairs.groupBy("client", "host").agg(F.collect_set(F.struct("standin", "value")).alias("pairs"))
    rows = chunks.join(maps, ["client", "host"], "left").select("stream_id", "syntax", "seq", "body", "last", "pairs")
    step = stepper(int(pd.Timedelta(idle).total_seconds() * 1000))
    return rows.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "pending binary, held string, tail string, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout)
