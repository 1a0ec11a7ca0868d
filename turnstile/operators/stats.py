"""Metric rollups, windows, caps and the frame ledger."""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import boxes, enrolments, frames, sightings, steps, tallies, taps, templates, watched


def _us(seconds: float) -> int:
    return int(seconds * 1_000_000)


@sql
def metric_rollup(d: Dialect) -> str:
    return f"""SELECT run_id, stage, count(value) AS n, min(value) AS least, round(avg(value), 6) AS mean, max(value) AS most
      FROM {sightings(d)} AS s GROUP BY run_id, stage"""


@sql
def stage_snapshot(d: Dialect) -> str:
    """Frames and frames a second per stage with a map of its metrics, idle stages left out.

    A metric without a value is null in the map, which isn't 0; the map is given as its entries in order.
    """
    def metric(name: str, value: str) -> str:
        return f"SELECT run_id, stage, '{name}' AS metric, round({value}, 4) AS amount FROM {sightings(d)} AS s GROUP BY run_id, stage"

    metrics = " UNION ALL ".join(metric(n, v) for n, v in (("least", "min(value)"), ("mean", "avg(value)"), ("most", "max(value)"), ("forced", "avg(CASE WHEN forced AND frame % 2 = 0 THEN value END)")))
    return f"""SELECT t.run_id, t.stage, n AS frames, CASE WHEN elapsed > 0 THEN floor(n * 1000.0E0 / elapsed * 1000 + 0.5) / 1000 END AS fps, {d.entries('metrics')} AS metrics FROM (
      SELECT s.run_id, s.stage, count(*) AS n, max(r.elapsed) AS elapsed FROM {sightings(d)} AS s
      JOIN (SELECT run_id, (max(us) - min(us)) / 1000.0E0 AS elapsed FROM {sightings(d)} AS s1 GROUP BY run_id) AS r ON r.run_id = s.run_id
      GROUP BY s.run_id, s.stage) AS t JOIN (SELECT run_id, stage, {d.metric_map('metric', 'amount')} AS metrics FROM ({metrics}) AS m0 GROUP BY run_id, stage) AS m
      ON m.run_id = t.run_id AND m.stage = t.stage WHERE n > 0"""


def _flushed(d: Dialect) -> str:
    return f"SELECT *, {d.whole(f'us / {_us(d.k.flush_seconds)}.0E0')} AS flush FROM {sightings(d)} AS s"


@sql
def sample_cap(d: Dialect) -> str:
    """A flush keeps its first rows and counts the rest."""
    cap = d.k.sample_cap
    return f"""SELECT run_id, flush, count(CASE WHEN rn <= {cap} THEN 1 END) AS kept, count(CASE WHEN rn > {cap} THEN 1 END) AS dropped FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, flush ORDER BY us, event_id) AS rn FROM ({_flushed(d)}) AS f) AS r GROUP BY run_id, flush"""


@sql
def flush_window(d: Dialect) -> str:
    return f"SELECT run_id, flush, count(*) AS n, round(sum(value), 4) AS total FROM ({_flushed(d)}) AS f GROUP BY run_id, flush"


@sql
def sample_chunks(d: Dialect) -> str:
    """Rows in chunks of at most 200, in order of arrival."""
    return f"""SELECT run_id, chunk, count(*) AS n, min(event_id) AS first_id FROM (SELECT run_id, event_id,
      {d.whole(f'(row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) - 1) / {d.k.chunk_rows}.0E0')} AS chunk FROM {sightings(d)} AS s) AS c GROUP BY run_id, chunk"""


@sql
def template_stats(d: Dialect) -> str:
    """The last template count of each key: how many keys have one, and the largest."""
    return f"""SELECT run_id, count(CASE WHEN n <= 1 THEN 1 END) AS singles, max(n) AS most, count(*) AS people FROM (
      SELECT run_id, key, n FROM (SELECT run_id, key, reported AS n, row_number() OVER (PARTITION BY run_id, key ORDER BY id DESC) AS rn
        FROM {templates(d)} AS t) AS r WHERE rn = 1) AS k GROUP BY run_id"""


@sql
def frame_ms(d: Dialect) -> str:
    """Milliseconds a stage took within a frame, summed over its calls."""
    return f"SELECT frame, stage, round(sum(value), 4) AS ms FROM {sightings(d)} AS s GROUP BY frame, stage"


@sql
def staff_crossings(d: Dialect) -> str:
    """Every sighting counts as a face frame; a crossing needs a gap since the last sighting."""
    return f"""SELECT track, count(*) AS face_frames, count(CASE WHEN gap IS NULL OR gap >= {_us(d.k.cooldown_seconds)} THEN 1 END) AS crossings FROM (
      SELECT track, us - lag(us) OVER (PARTITION BY track ORDER BY us, event_id) AS gap FROM {sightings(d)} AS s) AS g GROUP BY track"""


@sql
def stall_detect(d: Dialect) -> str:
    """Silences longer than the stall limit, with the sighting before each; ``trailing`` is one that lasts until the watch ended."""
    gaps = "lead(us) OVER (PARTITION BY run_id ORDER BY us, event_id)"
    return f"""SELECT g.run_id, event_id, coalesce(later, until_us) - us AS gap, later IS NULL AS trailing FROM (SELECT run_id, event_id, us, {gaps} AS later
      FROM {sightings(d)} AS s) AS g JOIN {watched(d)} AS w ON w.run_id = g.run_id WHERE coalesce(later, until_us) - us > {_us(d.k.stall_seconds)}"""


@sql
def new_sequence(d: Dialect) -> str:
    """A frame's number is read once, whenever it comes again: when it was first read, and how often."""
    return f"SELECT run_id, seq, min(us) AS us, count(*) AS reads FROM {frames(d)} AS f GROUP BY run_id, seq"


@sql
def latest_frame(d: Dialect) -> str:
    """Drop, don't queue: the newest frame of each run."""
    return f"SELECT run_id, seq, us FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM {frames(d)} AS f) AS r WHERE rn = 1"


@sql
def run_liveness(d: Dialect) -> str:
    """Newest event of each run; runs silent for the reap limit are reaped, the newest live one answers."""
    return f"""SELECT run_id, last_us, alive, alive AND row_number() OVER (ORDER BY CASE WHEN alive THEN 0 ELSE 1 END, last_us DESC, run_id) = 1 AS answers FROM (
      SELECT run_id, max(us) AS last_us, max(us) >= (SELECT max(us) FROM {sightings(d)} AS s0) - {_us(d.k.reap_seconds)} AS alive
      FROM {sightings(d)} AS s GROUP BY run_id) AS r"""


@sql
def ledger_upsert(d: Dialect) -> str:
    """Frame records are keyed by run and slot; the last to arrive stays."""
    return f"""SELECT run_id, slot, seq, round(cost, 2) AS cost FROM (SELECT *,
      row_number() OVER (PARTITION BY run_id, slot ORDER BY seq DESC) AS rn FROM {frames(d)} AS f) AS r WHERE rn = 1"""


@sql
def ledger_window(d: Dialect) -> str:
    """A window of the ledger, at most 500 rows, and whether it was truncated."""
    return f"""SELECT run_id, seq, us, total > {d.k.window_rows} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn,
      count(*) OVER (PARTITION BY run_id) AS total FROM {frames(d)} AS f WHERE seq BETWEEN {d.k.window_from} AND {d.k.window_to}) AS r WHERE rn <= {d.k.window_rows}"""


@sql
def frame_outcome(d: Dialect) -> str:
    """What a frame came to, the strongest outcome first."""
    return f"""SELECT frame, CASE WHEN faces = 0 THEN 'empty' WHEN kept = 0 THEN 'gated' WHEN enrolled > 0 THEN 'enrolled' WHEN matched > 0 THEN 'matched'
      WHEN minted > 0 THEN 'minted' WHEN near_misses > 0 THEN 'near-miss' WHEN kept < faces THEN 'partial' ELSE 'seen' END AS outcome FROM {tallies(d)} AS t"""


@sql
def tap_rows(d: Dialect) -> str:
    """Payload rows are rounded and capped; what was left out is stated."""
    cap = d.k.tap_rows
    return f"""SELECT frame, n, floor(x * 10 + 0.5) / 10 AS x, floor(conf * 1000 + 0.5) / 1000 AS conf, greatest(total - {cap}, 0) AS left_out
      FROM (SELECT *, count(*) OVER (PARTITION BY frame) AS total FROM {boxes(d)} AS b) AS t WHERE n <= {cap}"""


@sql
def deadline_budget(d: Dialect) -> str:
    """The calls of a round that start within its budget."""
    return f"""SELECT run_id, flush, count(CASE WHEN coalesce(spent, 0) < {d.k.round_budget_ms} THEN 1 END) AS made, count(CASE WHEN spent >= {d.k.round_budget_ms} THEN 1 END) AS abandoned FROM (
      SELECT run_id, flush, sum(value) OVER (PARTITION BY run_id, flush ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent
      FROM ({_flushed(d)}) AS f) AS b GROUP BY run_id, flush"""


@sql
def last_per_track(d: Dialect) -> str:
    """The last sightings of each track, four unless told otherwise."""
    return f"""SELECT track, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY us DESC, event_id DESC) AS rn
      FROM {sightings(d)} AS s) AS r WHERE rn <= {d.k.last_seen}"""


@sql
def distinct_tracks(d: Dialect) -> str:
    return f"SELECT run_id, count(DISTINCT track) AS tracks FROM {sightings(d)} AS s GROUP BY run_id"


@sql
def run_results(d: Dialect) -> str:
    """A run's wide row of results, and its note."""
    return f"""SELECT run_id, sightings, tracks, round(total, 2) AS total, concat(CAST(tracks AS {d.text}), ' tracks in ', CAST(sightings AS {d.text}), ' sightings') AS note
      FROM (SELECT run_id, count(*) AS sightings, count(DISTINCT track) AS tracks, sum(value) AS total FROM {sightings(d)} AS s GROUP BY run_id) AS r"""


@sql
def enrol_tally(d: Dialect) -> str:
    """Faces that the gate kept decide: a frame with exactly one is a sample."""
    return f"""SELECT run_id, count(*) AS frames, CAST(sum(faces) AS BIGINT) AS faces_seen, count(CASE WHEN kept = 1 THEN 1 END) AS samples, count(CASE WHEN kept <> 1 THEN 1 END) AS skipped
      FROM (SELECT run_id, frame, count(*) AS faces, count(CASE WHEN kept THEN 1 END) AS kept FROM {enrolments(d)} AS e GROUP BY run_id, frame) AS f GROUP BY run_id"""


@sql
def enrol_shortlist(d: Dialect) -> str:
    """Frames with exactly one kept face; each run's best by score."""
    return f"""SELECT run_id, frame, conf FROM (SELECT run_id, frame, conf, row_number() OVER (PARTITION BY run_id ORDER BY conf DESC, frame) AS place
      FROM (SELECT run_id, frame, max(conf) AS conf FROM {enrolments(d)} AS e WHERE kept GROUP BY run_id, frame HAVING count(*) = 1) AS f) AS r WHERE place <= {d.k.enrol_best}"""


@sql
def settle_class(d: Dialect) -> str:
    """How a run ended: a stall settles as failed."""
    return f"SELECT seq, end_reason, CASE WHEN end_reason IN ('source-ended', 'operator-stopped') THEN 'ended' ELSE 'failed' END AS settled FROM {frames(d)} AS f"


@sql
def card_hysteresis(d: Dialect) -> str:
    """A new best face card needs 1.25 times the last accepted one: a fold in order."""
    rows = f"SELECT track, event_id, value, row_number() OVER (PARTITION BY track ORDER BY us, event_id) AS k FROM {sightings(d)} AS s"
    if d.spark:
        return f"""SELECT track, c.event_id AS event_id, c.value AS value FROM (SELECT track, explode(aggregate(array_sort(collect_list(struct(k, event_id, value))),
            CAST(array() AS ARRAY<STRUCT<k: INT, event_id: BIGINT, value: DOUBLE>>),
            (a, x) -> CASE WHEN size(a) = 0 OR x.value >= {d.k.card_gain} * element_at(a, -1).value THEN concat(a, array(x)) ELSE a END)) AS c
          FROM ({rows}) AS r GROUP BY track) AS e"""
    return f"""WITH RECURSIVE r AS ({rows}), step AS (
      SELECT track, k, event_id, value, value AS held, true AS taken FROM r WHERE k = 1
      UNION ALL
      SELECT r.track, r.k, r.event_id, r.value, CASE WHEN r.value >= {d.k.card_gain} * s.held THEN r.value ELSE s.held END, r.value >= {d.k.card_gain} * s.held
      FROM step AS s JOIN r ON r.track = s.track AND r.k = s.k + 1)
      SELECT track, event_id, value FROM step WHERE taken"""


@sql
def unique_clamped(d: Dialect) -> str:
    """The running count of people: mints and manual adds up, merges and folds down, never below 0.

    The clamped count is S - min(0, least prefix sum), so it is a scan of two levels and no fold:
    prefix sums and their least within segments of time, each in its own task, then over a run's segments.
    """
    if d.spark:
        segment = d.whole(f"us / {_us(d.k.segment_seconds)}.0E0")
        scan = f"""SELECT run_id, segment, delta, sum(delta) OVER (PARTITION BY run_id, segment ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS prefix
          FROM (SELECT run_id, us, event_id, CAST(delta AS BIGINT) AS delta, {segment} AS segment FROM {steps(d)} AS s) AS g"""
        folded = f"SELECT run_id, segment, sum(delta) AS total, min(prefix) AS low, count(*) AS n FROM ({scan}) AS p GROUP BY run_id, segment"
        before = f"""SELECT *, coalesce(sum(total) OVER (PARTITION BY run_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({folded}) AS f"""
        return f"SELECT run_id, sum(total) - least(0, min(before + low)) AS people, sum(n) AS steps FROM ({before}) AS b GROUP BY run_id"
    rows = f"SELECT run_id, CAST(delta AS BIGINT) AS delta, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS k FROM {steps(d)} AS s"
    return f"""WITH RECURSIVE r AS ({rows}), step AS (
      SELECT run_id, k, greatest(0, delta) AS people FROM r WHERE k = 1
      UNION ALL
      SELECT r.run_id, r.k, greatest(0, s.people + r.delta) FROM step AS s JOIN r ON r.run_id = s.run_id AND r.k = s.k + 1)
      SELECT run_id, CAST(arg_max(people, k) AS BIGINT) AS people, max(k) AS steps FROM step GROUP BY run_id"""


@sql
def tap_duty(d: Dialect) -> str:
    """A tap waits for its interval and three times its last cost; a forced one only for the latter."""
    rows = f"SELECT track, event_id, us, cost_us, forced, row_number() OVER (PARTITION BY track ORDER BY us, event_id) AS k FROM {taps(d)} AS s"
    never, wait, held = -(1 << 60), _us(d.k.tap_interval_seconds), "us + CAST({duty} * {x}cost_us AS BIGINT)"
    if d.spark:
        ready = f"x.us >= a.free AND (x.forced OR x.us >= a.last + {wait}L)"
        return f"""SELECT track, taps FROM (SELECT track, aggregate(array_sort(collect_list(struct(k, us, cost_us, forced))),
            CAST(struct({never}L AS last, {never}L AS free, 0L AS taps) AS STRUCT<last: BIGINT, free: BIGINT, taps: BIGINT>),
            (a, x) -> CASE WHEN {ready} THEN named_struct('last', x.us, 'free', x.{held.format(duty=d.k.tap_duty, x='x.')}, 'taps', a.taps + 1L) ELSE a END).taps AS taps
          FROM ({rows}) AS r GROUP BY track) AS e"""
    ready = f"r.us >= s.free AND (r.forced OR r.us >= s.last + {wait})"
    return f"""WITH RECURSIVE r AS ({rows}), step AS (
      SELECT track, 0::BIGINT AS k, {never}::BIGINT AS last, {never}::BIGINT AS free, 0::BIGINT AS taps FROM r WHERE k = 1
      UNION ALL
      SELECT r.track, r.k, CASE WHEN {ready} THEN r.us ELSE s.last END, CASE WHEN {ready} THEN r.{held.format(duty=d.k.tap_duty, x='r.')} ELSE s.free END,
        CASE WHEN {ready} THEN s.taps + 1 ELSE s.taps END FROM step AS s JOIN r ON r.track = s.track AND r.k = s.k + 1)
      SELECT track, max(taps) AS taps FROM step GROUP BY track"""
