"""Watching a stream of frames: numbers that come again, and runs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnstile.settings import DEFAULTS, Settings

STALLS_DDL = "run_id long, seq long, last timestamp, state string"


def new_frames(frames: DataFrame, late: str = "1 minute") -> DataFrame:
    """``run_id, seq, ts``: each number of a run once, however often it is read within ``late``."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


class StallWatch(StatefulProcessor):
    """The last frame of each run, and a timer that fires when none has followed it for too long.

    Timers run on the watermark, so a silent run is noticed as soon as others go on,
    or on the clock (``by_clock``), so that it is noticed when nothing at all comes.
    A run that comes back after a stall says so once.
    """

    def __init__(self, stall_ms: int, by_clock: bool):
        self.stall_ms, self.by_clock = stall_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, ms long, stalled boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"])
        newest = seen.iloc[-1]
        ms = int(pd.Timestamp(newest["ts"]).value // 1_000_000)
        stalled = False
        if self.last.exists():
            _, before, stalled = self.last.get()
            if ms <= before:  # only late frames: nothing new is known
                return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((int(newest["seq"]), ms, False))
        start = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else ms
        self.handle.registerTimer(start + self.stall_ms)
        if stalled:
            yield pd.DataFrame({"run_id": [int(key[0])], "seq": [int(newest["seq"])], "last": [pd.Timestamp(newest["ts"])], "state": ["resumed"]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        seq, ms, _ = self.last.get()
        self.last.update((seq, ms, True))
        yield pd.DataFrame({"run_id": [int(key[0])], "seq": [seq], "last": [pd.Timestamp(ms, unit="ms")], "state": ["source-stalled"]})

    def close(self) -> None:
        pass


def stalls_stream(frames: DataFrame, settings: Settings = DEFAULTS, by_clock: bool = False, late: str = "0 seconds") -> DataFrame:
    """Runs of ``run_id, seq, ts`` that fell silent for ``stall_seconds`` (a failure), and those that came back.

    Needs the RocksDB state store.
    """
    watched = frames.select("run_id", "seq", "ts").withWatermark("ts", late)
    return watched.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=StallWatch(int(settings.stall_seconds * 1000), by_clock), outputStructType=STALLS_DDL, outputMode="Append",
        timeMode="ProcessingTime" if by_clock else "EventTime",
    )
