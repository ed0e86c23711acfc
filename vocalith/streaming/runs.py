"""Runs of speech over a stream of frames, merged over short gaps, with state in Spark's state store.

Frames of a recording wait in its state until the watermark has passed them, so they may come in any order within the
watermark's delay; what comes later is dropped by Spark. A run is what ``series.speech_runs`` and ``series.merge_runs`` make of the
frames: it ends at the first frame after it, runs shorter than ``least_s`` go, and runs no further apart than ``gap_s`` become
one. A run is given out once the watermark tells that nothing can be merged to it any more. A recording that has had no
frame for ``idle_s`` has ended: its open run ends at its last frame, and its state is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MS = 1000.0


class Runs:
    """The runs of one recording, frame by frame in order. Times in ms; ``done`` collects what is finished."""

    def __init__(self, least: float, gap: float, start: int | None = None, pending: tuple[int, int, int] | None = None):
        self.least, self.gap, self.start, self.pending, self.done = least, gap, start, pending, []

    def frame(self, ts: int, speech: bool) -> None:
        if speech and self.start is None:
            self.start = ts
        elif not speech and self.start is not None:
            self.close(ts)
        if self.start is None or (self.pending and self.start - self.pending[1] > self.gap):
            self.settle(ts)

    def close(self, end: int) -> None:
        start, self.start = self.start, None
        if start is None or end - start < self.least:
            return
        if self.pending and start - self.pending[1] <= self.gap:
            self.pending = (self.pending[0], end, self.pending[2] + 1)
        else:
            if self.pending:
                self.done.append(self.pending)
            self.pending = (start, end, 1)

    def settle(self, now: int) -> None:
        """Nothing that starts at ``now`` or later can be merged to a run that ended more than the gap before."""
        if self.pending and now - self.pending[1] > self.gap:
            self.done.append(self.pending)
            self.pending = None


class _Processor(StatefulProcessor):
    def __init__(self, by: str, least_s: float, gap_s: float, idle_s: float):
        self.by, self.least, self.gap, self.idle = by, least_s * _MS, gap_s * _MS, int(idle_s * _MS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, speech boolean")
        self.runs = handle.getValueState("runs", "start long, a long, b long, n long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for x in rows:
            ms = x["frame_ms"].astype("int64")
            self.waiting.appendList(list(zip(ms.tolist(), x["frame_speech"].astype(bool).tolist(), strict=True)))
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=[self.by, "start_ms", "end_ms", "runs"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        frames = sorted((int(t), bool(s)) for t, s in (self.waiting.get() if self.waiting.exists() else []))
        ready, later = [f for f in frames if f[0] <= now], [f for f in frames if f[0] > now]
        start, a, b, n, last = self.runs.get() if self.runs.exists() else (None,) * 5
        runs = Runs(self.least, self.gap, start, None if a is None else (a, b, n))
        for ts, speech in ready:
            runs.frame(ts, speech)
            last = ts
        ended = not later and last is not None and now >= last + self.idle
        if ended:
            runs.close(last)
            runs.settle(last + int(self.gap) + 1)
            self.waiting.clear()
            self.runs.clear()
        else:
            if ready:
                self.waiting.put(later) if later else self.waiting.clear()
            pending = runs.pending or (None, None, None)
            self.runs.update((runs.start, *pending, last))
            self.handle.registerTimer(max(now + 1, later[0][0] if later else (last or now) + self.idle))
        yield pd.DataFrame([(key[0], *x) for x in runs.done], columns=[self.by, "start_ms", "end_ms", "runs"])

    def close(self) -> None:
        pass


def merged_runs(frames: DataFrame, by: str, ts: str, speech: str, delay: str = "10 seconds", least_s: float = 0.1, gap_s: float = 0.3, idle_s: float = 60.0) -> DataFrame:
    """Streaming frames (by, ts timestamp, speech boolean) -> finished runs (by, start_ms, end_ms, runs), in append mode.

    ``by`` must not be null. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    kind = frames.schema[by].dataType.simpleString()
    rows = frames.select(F.col(by), F.col(ts).alias("frame_time"), F.unix_millis(F.col(ts).cast("timestamp")).alias("frame_ms"), F.coalesce(F.col(speech), F.lit(False)).alias("frame_speech"))
    return rows.withWatermark("frame_time", delay).groupBy(by).transformWithStateInPandas(
        statefulProcessor=_Processor(by, least_s, gap_s, idle_s), outputStructType=f"`{by}` {kind}, start_ms long, end_ms long, runs long", outputMode="Append", timeMode="EventTime"
    )
