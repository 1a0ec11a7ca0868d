"""Streams: tracking with keyed state, debounced crossings, and metric upserts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnstile.operators.folds import TRACKS_DDL, Tracker, track_rows
from turnstile.settings import DEFAULTS, Settings

#: A tracker without frames for so long is dropped.
IDLE_MS = 3_600_000


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = 0, settings: Settings = DEFAULTS) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    tracker = pickle.loads(state.get[0]) if state.exists else Tracker(settings)
    rows = pd.concat(list(frames)).sort_values(["frame", "n"])
    out = track_rows(int(key[0]), rows, tracker)
    state.update((pickle.dumps(tracker),))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=["run_id", "frame", "n", "track"])


def track_stream(boxes: DataFrame, idle_ms: int = IDLE_MS, settings: Settings = DEFAULTS) -> DataFrame:
    """Confirmed tracks of a stream of ``run_id, frame, n, x, y, w, h``, frames in order per run.

    The same fold as the batch tracker; its state is the tracker of each run.
    ``idle_ms`` drops idle trackers; 0 keeps them. With it the query runs batches
    without data for as long as it lives, as Spark does for such timeouts.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    advance = lambda key, frames, state: _advance(key, frames, state, idle_ms, settings)
    return boxes.groupBy("run_id").applyInPandasWithState(advance, TRACKS_DDL, "tracker binary", "append", timeout)


def crossings_stream(sightings: DataFrame, gap: str | None = None, late: str = "1 hour", settings: Settings = DEFAULTS) -> DataFrame:
    """Debounced crossings of ``track, ts``: one row per session, closed by the gap (the cooldown of the settings) and the watermark."""
    gap = gap or f"{int(settings.cooldown_seconds * 1000)} milliseconds"
    sessions = sightings.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "track")
    return sessions.agg(F.count("*").alias("face_frames")).select(
        "track", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "face_frames"
    )


def metrics_stream(samples: DataFrame, window: str | None = None, late: str = "1 minute", settings: Settings = DEFAULTS) -> DataFrame:
    """Metric rollups of ``run_id, stage, value, ts`` per aligned flush window."""
    window = window or f"{int(settings.flush_seconds * 1000)} milliseconds"
    by = samples.withWatermark("ts", late).groupBy(F.window("ts", window), "run_id", "stage")
    out = by.agg(F.count("value").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return out.select("run_id", "stage", F.col("window.start").alias("flush"), "n", "least", "mean", "most")
