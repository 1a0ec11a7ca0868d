"""The accuracy harness: funnels, named checks, scores, and a verdict on a change.

Throughput is never looked at: a faster pipeline that counts fewer people is a
regression.
"""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.settings import Settings
from turnstile.sources.bindings import clips, manifest, prior, runs, sightings, waivers


@sql
def stage_distribution(d: Dialect) -> str:
    """A map from each stage of a run to the number of its values, and one to their mean: a stage that was never emitted isn't
    in them, one emitted without values counts 0 and has no mean. Maps are given as their entries in order."""
    by_stage = f"SELECT run_id, stage, count(value) AS n, round(avg(value), 4) AS mean FROM {sightings(d)} AS s GROUP BY run_id, stage"
    return f"""SELECT run_id, {d.entries('counts')} AS counts, {d.entries('means')} AS means FROM (
      SELECT run_id, {d.metric_map('stage', 'n')} AS counts, {d.metric_map('stage', 'mean')} AS means FROM ({by_stage}) AS b GROUP BY run_id) AS m"""


def _funnel(d: Dialect) -> str:
    """Frames of the stage, or else of the results; an embedder that never reported did nothing, one that doesn't tell is unknown."""
    return f"""(SELECT clip, half, coalesce(nullif(frames, 0), result_frames, 0) AS frames, person_boxes, faces, passing, CASE WHEN embed_row THEN embeds ELSE 0 END AS embeds,
      matches, uniq, end_reason, face_width, ingest_fps, count_fps FROM {runs(d)} AS r0)"""


@sql
def funnel(d: Dialect) -> str:
    return f"SELECT clip, half, frames, person_boxes, faces, passing, embeds, matches, uniq FROM {_funnel(d)} AS r"


@sql
def run_fps(d: Dialect) -> str:
    """Both rates, apart: of decoding and end to end. Neither is ever scored."""
    return f"SELECT clip, half, ingest_fps, count_fps FROM {_funnel(d)} AS r"


def _scored(d: Dialect) -> str:
    """Runs with their clip's truth; only runs to the end of the source are scorable."""
    return f"""SELECT r.*, c.actual, c.tags, r.end_reason = 'source-ended' AS scorable, CASE WHEN r.end_reason = 'source-ended' THEN (r.uniq - c.actual) * 1.0E0 / c.actual END AS err,
      CASE WHEN r.faces > 0 THEN r.passing * 1.0E0 / r.faces END AS rate FROM {_funnel(d)} AS r JOIN {clips(d)} AS c ON c.clip = r.clip"""


@sql
def unique_error(d: Dialect) -> str:
    """The signed relative error of the count, and whether it is within the envelope."""
    return f"SELECT clip, half, {d.fail_unless('actual >= 1', 'a clip needs one person at least', 'round(err, 6)')} AS err, abs(err) <= {d.k.envelope} + 1.0E-12 AS within FROM ({_scored(d)}) AS s WHERE scorable"


@sql
def gate_pass_rate(d: Dialect) -> str:
    return f"SELECT clip, half, round(rate, 6) AS rate FROM ({_scored(d)}) AS s"


@sql
def is_scorable(d: Dialect) -> str:
    return f"SELECT clip, half, end_reason, scorable, CASE WHEN NOT scorable THEN concat('end reason ', end_reason) END AS why FROM ({_scored(d)}) AS s"


def checks(k: Settings) -> tuple[tuple[str, str, str], ...]:
    """Name, severity, and the condition under which a check fails."""
    return (
        ("no-frames", "critical", "frames <= 0"),
        ("no-faces-detected", "critical", "frames > 0 AND faces = 0"),
        ("gate-pass-collapse", "critical", "faces > 0 AND passing = 0"),
        ("embed-ran", "critical", "embeds IS NOT NULL AND passing <> 0 AND embeds = 0"),
        ("match-ran", "critical", "coalesce(embeds, passing) <> 0 AND matches = 0"),
        ("counted-nobody", "critical", "actual > 0 AND uniq = 0"),
        ("unique-count-error", "fail", f"err IS NULL OR abs(err) > {k.envelope} + 1.0E-12"),
        ("gate-pass-rate", "warn", f"rate IS NOT NULL AND rate <> 0 AND rate < {k.low_gate_rate}"),
        ("face-size-vs-floor", "warn", f"face_width < {k.face_floor}"),
    )


def _checks(d: Dialect) -> str:
    """A row for each scorable run and check: the runs are read once and meet the nine literal rows."""
    named = ", ".join(f"({i}, '{name}', '{severity}')" for i, (name, severity, _) in enumerate(checks(d.k), 1))
    failed = " ".join(f"WHEN {i} THEN {fails}" for i, (_, _, fails) in enumerate(checks(d.k), 1))
    return f"""SELECT clip, half, place, name, severity, NOT coalesce(CASE place {failed} END, false) AS passed
      FROM ({_scored(d)}) AS s CROSS JOIN (VALUES {named}) AS k(place, name, severity) WHERE scorable"""


@sql
def eval_checks(d: Dialect) -> str:
    return f"SELECT clip, half, place, name, severity, passed FROM ({_checks(d)}) AS k"


def scores(d: Dialect) -> str:
    """Every run's verdict: errored where it can't be scored, else pass or fail by its checks."""
    return f"""SELECT s.clip, s.half, s.actual, s.uniq, s.err, s.rate, s.tags, s.frames, s.faces, s.passing, s.scorable, s.end_reason,
      CASE WHEN NOT s.scorable THEN 'errored' WHEN coalesce(k.failed, 0) = 0 THEN 'pass' ELSE 'fail' END AS verdict, coalesce(k.criticals, 0) AS criticals
      FROM ({_scored(d)}) AS s LEFT JOIN (SELECT clip, half, count(CASE WHEN severity <> 'warn' THEN 1 END) AS failed,
        count(CASE WHEN severity = 'critical' THEN 1 END) AS criticals FROM ({_checks(d)}) AS c WHERE NOT passed GROUP BY clip, half) AS k
      ON k.clip = s.clip AND k.half = s.half"""


@sql
def run_exit_code(d: Dialect) -> str:
    """What a harness run exits with: 0 where every clip was scored and passed, else 2."""
    return f"""SELECT half, count(*) AS clips, count(CASE WHEN verdict = 'errored' THEN 1 END) AS errored, count(CASE WHEN verdict = 'fail' THEN 1 END) AS failed,
      CASE WHEN count(CASE WHEN verdict <> 'pass' THEN 1 END) > 0 THEN 2 ELSE 0 END AS exit_code FROM ({scores(d)}) AS v GROUP BY half"""


@sql
def eval_score(d: Dialect) -> str:
    return f"SELECT clip, half, verdict, criticals, uniq, actual, round(err, 6) AS err, round(rate, 6) AS rate FROM ({scores(d)}) AS v"


@sql
def eval_aggregate(d: Dialect) -> str:
    """One row per set: counts, mean errors, and the worst clip (the first of equals)."""
    return f"""SELECT half, count(*) AS clips, count(CASE WHEN scorable THEN 1 END) AS scored, count(CASE WHEN NOT scorable THEN 1 END) AS errored,
      count(CASE WHEN verdict = 'pass' THEN 1 END) AS passed, count(CASE WHEN verdict = 'fail' THEN 1 END) AS failed,
      count(CASE WHEN abs(err) <= {d.k.envelope} + 1.0E-12 THEN 1 END) AS within_envelope, round(avg(err), 6) AS mean_signed, round(avg(abs(err)), 6) AS mean_abs,
      max(CASE WHEN worst = 1 AND scorable THEN clip END) AS worst_clip, count(CASE WHEN criticals > 0 AND scorable THEN 1 END) AS critical_clips FROM (
      SELECT *, row_number() OVER (PARTITION BY half ORDER BY CASE WHEN scorable THEN 0 ELSE 1 END, abs(err) DESC, clip) AS worst FROM ({scores(d)}) AS v) AS w GROUP BY half"""


@sql
def eval_by_tag(d: Dialect) -> str:
    return f"""SELECT half, tag, count(*) AS clips, round(avg(abs(err)), 6) AS mean_abs FROM (
      SELECT half, err, tag FROM (SELECT * FROM ({scores(d)}) AS v WHERE scorable) AS v1 {d.rows('v1.tags', 'x', 'tag')}) AS t GROUP BY half, tag"""


def _deltas(d: Dialect) -> str:
    """Clips of the set before (half 0) with the set after, and what fell."""
    fall = lambda b, a: f"CASE WHEN {b} > 0 AND {a} IS NOT NULL THEN ({b} - {a}) / {b} END"
    part = lambda h: f"(SELECT *, CASE WHEN frames > 0 THEN passing * 1.0E0 / frames END AS gate_yield, CASE WHEN frames > 0 THEN faces * 1.0E0 / frames END AS face_yield FROM ({scores(d)}) AS v WHERE half = {h})"
    news = f"""SELECT clip, count(CASE WHEN severity <> 'warn' THEN 1 END) AS new_failures, count(CASE WHEN severity = 'warn' THEN 1 END) AS new_warnings FROM (
      SELECT clip, name, severity FROM ({_checks(d)}) AS c GROUP BY clip, name, severity
      HAVING count(CASE WHEN half = 1 AND NOT passed THEN 1 END) > 0 AND count(CASE WHEN half = 0 AND NOT passed THEN 1 END) = 0) AS n GROUP BY clip"""
    return f"""SELECT b.clip, a.clip IS NULL AND w.clip IS NULL AS missing, a.clip IS NULL AND w.clip IS NOT NULL AS waived, b.scorable AS scored_before, a.scorable AS scored_after, b.err AS err_before, a.err AS err_after,
      b.actual <> a.actual AS truth_moved, b.scorable AND NOT a.scorable AS lost, b.passing > 0 AND a.passing = 0 AS collapsed,
      {fall('b.rate', 'a.rate')} AS rate_fall, {fall('b.gate_yield', 'a.gate_yield')} AS gate_fall, {fall('b.face_yield', 'a.face_yield')} AS face_fall,
      b.uniq > 0 AND a.uniq = 0 AS nobody, abs(a.err) - abs(b.err) AS delta, coalesce(n.new_failures, 0) AS new_failures, coalesce(n.new_warnings, 0) AS new_warnings,
      NOT b.scorable AND a.scorable AS became_scorable, a.passing > b.passing AS more_passing
      FROM {part(0)} AS b LEFT JOIN {part(1)} AS a ON a.clip = b.clip LEFT JOIN ({news}) AS n ON n.clip = b.clip LEFT JOIN {waivers(d)} AS w ON w.clip = b.clip"""


def _compared(d: Dialect) -> str:
    one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    gate = f"collapsed OR rate_fall >= {d.k.yield_drop} OR gate_fall >= {d.k.yield_drop}"  # one reason for one cause
    return f"""SELECT *, CASE WHEN waived THEN 0 WHEN missing THEN 1 ELSE {' + '.join(map(one, ('truth_moved', 'lost', gate, f'face_fall >= {d.k.yield_drop}', 'nobody', f'delta > {d.k.error_tolerance}')))} + new_failures END AS regressions,
      {one('became_scorable')} + {one(f'delta < -{d.k.error_tolerance}')} + {one(f'more_passing AND NOT coalesce({gate}, false)')} AS improvements, new_warnings AS concerns
      FROM ({_deltas(d)}) AS p"""


@sql
def eval_compare(d: Dialect) -> str:
    return f"""SELECT clip, missing, waived, round(err_before, 6) AS err_before, round(err_after, 6) AS err_after, round(delta, 6) AS delta, round(rate_fall, 6) AS rate_fall,
      CAST(regressions AS BIGINT) AS regressions, CAST(improvements AS BIGINT) AS improvements, CAST(concerns AS BIGINT) AS concerns FROM ({_compared(d)}) AS c"""


@sql
def eval_only_after(d: Dialect) -> str:
    """Clips of the set after the change that weren't in the one before: reported, not compared."""
    sides = lambda h: f"(SELECT DISTINCT clip FROM {runs(d)} AS r{h} WHERE half = {h})"
    return f"SELECT clip FROM {sides(1)} AS a EXCEPT SELECT clip FROM {sides(0)} AS b"


@sql
def eval_paired(d: Dialect) -> str:
    """Clips that both sets hold."""
    sides = lambda h: f"(SELECT DISTINCT clip FROM {runs(d)} AS r{h} WHERE half = {h})"
    return f"SELECT clip FROM {sides(0)} AS b INTERSECT SELECT clip FROM {sides(1)} AS a"


@sql
def eval_verdict(d: Dialect) -> str:
    """Any regression decides, a missing clip being one unless it is waived; then nothing compared or a new warning is inconclusive; then the mean error."""
    t = d.k.error_tolerance
    return f"""SELECT CASE WHEN bad > 0 THEN 'regression' WHEN pairs = 0 OR warned > 0 THEN 'inconclusive' WHEN after_abs - before_abs < -{t} THEN 'improvement' ELSE 'neutral' END AS verdict,
      pairs, bad, warned, waived, round(before_abs, 6) AS before_abs, round(after_abs, 6) AS after_abs FROM (
      SELECT count(CASE WHEN paired THEN 1 END) AS pairs, count(CASE WHEN regressions > 0 THEN 1 END) AS bad, count(CASE WHEN concerns > 0 AND paired THEN 1 END) AS warned,
        count(CASE WHEN waived THEN 1 END) AS waived, avg(CASE WHEN paired THEN abs(err_before) END) AS before_abs, avg(abs(err_after)) AS after_abs
      FROM (SELECT *, NOT missing AND NOT waived AS paired FROM ({_compared(d)}) AS c0) AS c) AS v"""


@sql
def resume_carry(d: Dialect) -> str:
    """Prior scores carry over where path, truth, tags and envelope are as they were; an unknown envelope is tolerated. Else the first thing that changed."""
    e = d.k.envelope
    return f"""SELECT clip, clip_before IS NOT NULL AND why IS NULL AS carried, why FROM (SELECT c.clip, p.clip AS clip_before, CASE WHEN p.clip IS NULL THEN 'new'
        WHEN p.path IS DISTINCT FROM c.path THEN 'path' WHEN p.actual IS DISTINCT FROM c.actual THEN 'actual' WHEN p.tags IS DISTINCT FROM c.tags THEN 'tags'
        WHEN coalesce(p.envelope, {e}) <> {e} THEN 'envelope' END AS why FROM {clips(d)} AS c LEFT JOIN {prior(d)} AS p ON p.clip = c.clip) AS r"""


@sql
def manifest_validate(d: Dialect) -> str:
    """What is wrong with each clip of a manifest, first fault first; null if nothing."""
    unknown = d.size(d.keep("tags", "x", "x NOT IN ('surge', 'veil', 'children', 'staff', 'evening-light')"))
    return f"""SELECT clip, CASE WHEN n > 1 THEN 'label' WHEN NOT {d.matches('path', '^/')} THEN 'path' WHEN actual < 1 THEN 'actual' WHEN unknown > 0 THEN 'tags' END AS fault FROM (
      SELECT clip, path, actual, count(*) OVER (PARTITION BY label) AS n, {unknown} AS unknown FROM {manifest(d)} AS m0) AS m"""
