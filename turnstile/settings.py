"""Every knob of the engine; 0 switches one off, an empty string means unset."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # Identity resolution.
    match_threshold: float = 0.363
    enrol_confidence: float = 0.05
    enrol_margin: float = 0.05
    enrol_max_cosine: float = 0.90
    template_cap: int = 5
    canon_width: float = 80.0
    clothing_clash: float = 0.50
    near_miss_floor: float = 0.29
    near_miss_weak: float = 0.15
    near_miss_clothes: float = 0.78
    band_tolerance: float = 1e-6
    review_floor: float = 0.29
    review_limit: int = 100
    # Gate.
    sub_canon_width: float = 56.0
    ied_floor: float = 0.0
    frontality_floor: float = 0.0
    sharpness_floor: float = 0.0
    # Boxes.
    detect_score: float = 0.30
    nms_iou: float = 0.45
    dedupe_iou: float = 0.60
    track_iou: float = 0.20
    track_max_misses: int = 30
    track_min_hits: int = 3
    track_velocity: float = 0.5
    letterbox_side: int = 416
    frame_width: int = 0
    frame_height: int = 0
    # Reconciliation.
    heal_seconds: float = 20.0
    heal_cosine: float = 0.45
    lock_cosine: float = 0.45
    lock_seconds: float = 20.0
    clothing_refuse: float = 0.35
    clothing_uncertain: float = 0.55
    same_frame_clothing: float = 0.35
    co_presence_cap: int = 4000
    recent_mints: int = 4
    retired_rows: int = 500
    last_seen: int = 4
    cooldown_seconds: float = 5.0
    card_gain: float = 1.25
    enrol_best: int = 5
    # Reporting.
    flush_seconds: float = 2.0
    sample_cap: int = 200
    stall_seconds: float = 45.0
    reap_seconds: float = 600.0
    tap_rows: int = 40
    chunk_rows: int = 200
    window_rows: int = 500
    window_from: int = 0
    window_to: int = 1 << 62
    segment_seconds: float = 3600.0
    tap_interval_seconds: float = 2.0
    tap_duty: float = 3.0
    payload_bytes: int = 32_768
    round_budget_ms: float = 3000.0
    retention_seconds: float = 86_400.0
    # Evaluation.
    envelope: float = 0.05
    low_gate_rate: float = 0.10
    error_tolerance: float = 0.005
    yield_drop: float = 0.5
    face_floor: float = 56.0

    @classmethod
    def from_env(cls, prefix: str = "TURNSTILE_") -> Settings:
        """Knobs from the environment; a value that doesn't parse is an error."""
        given = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper(), "").strip()
            if raw:
                try:
                    given[f.name] = type(f.default)(raw)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} is no {type(f.default).__name__}") from e
        return cls(**given)


DEFAULTS = Settings()

#: For the given tables: their clock is coarse and their boxes are synthetic, so knobs
#: are moved to where both outcomes of every test occur.
FIXTURE = replace(
    DEFAULTS,
    detect_score=0.92,
    ied_floor=10.0,
    frontality_floor=0.93,
    sharpness_floor=20.0,
    heal_seconds=7200.0,
    lock_seconds=7200.0,
    cooldown_seconds=6 * 3600.0,
    stall_seconds=600.0,
    flush_seconds=3600.0,
    sample_cap=3,
    letterbox_side=64,
    frame_width=40,
    frame_height=32,
    window_from=100,
    window_to=60_000,
    segment_seconds=86_400.0,
    tap_rows=4,
    tap_interval_seconds=7200.0,
    payload_bytes=200,
    round_budget_ms=200.0,
    low_gate_rate=0.4,
    face_floor=22.4,
)
