"""Payloads and reports: JSON rows for a sink, and text for a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnstile.operators.evals import scores
from turnstile.operators.gate import judged
from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import acts, boxes, tracks

#: Bytes of one payload (a fixed value of the sink's contract).
BUDGET = 32 * 1024


def _tidy(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


def _box(d: Dialect, **more: str) -> str:
    return d.struct(n="n", **{c: _tidy(c, 1) for c in "xywh"}, **more)


def _listed(d: Dialect, rows: str, item: str, by: str, extra: str = "") -> str:
    """A JSON payload a group: its first rows, at most the cap, and how many were left out."""
    shown = d.head(d.sorted_list(item, "n"), d.k.tap_rows)
    payload = d.to_json(d.struct(rows="shown", left_out="left_out"))
    return f"""SELECT {by}, payload, CAST({d.octets('payload')} AS BIGINT) AS bytes{extra} FROM (SELECT *, {payload} AS payload FROM (
      SELECT {by}, {shown} AS shown, greatest(count(*) - {d.k.tap_rows}, 0) AS left_out FROM {rows} AS r GROUP BY {by}) AS g) AS p"""


@sql
def tap_payload(d: Dialect) -> str:
    """Person boxes of each frame."""
    return _listed(d, boxes(d), _box(d, conf=_tidy("conf", 3)), "frame")


@sql
def track_payload(d: Dialect) -> str:
    """Reported tracks of each frame."""
    return _listed(d, tracks(d), _box(d), "frame")


@sql
def face_payload(d: Dialect) -> str:
    """Faces of each frame with what the gate said: read from its verdict, never judged again."""
    k = d.k
    band = f"CASE WHEN width_px < {k.sub_canon_width} THEN 'gated' WHEN width_px < {k.canon_width} THEN 'sub-canon' ELSE 'canon' END"
    item = _box(d, width=_tidy("width_px", 1), quality=band, conf=_tidy("conf", 3), gate="coalesce(rejected_by, 'kept')")
    return _listed(d, f"({judged(d)})", item, "frame")


@sql
def match_payload(d: Dialect) -> str:
    """Matches and mints of each run within the budget: older mints are shed first, then matches beyond the first ten.

    Both lists start at the cap of rows; bytes are those of the JSON that is sent.
    """
    ids = lambda c: d.sorted_list(f"CASE WHEN {c} THEN event_id END", "event_id")
    size = lambda a, b: f"CAST({d.octets(d.to_json(d.struct(mints=a, matches=b)))} AS BIGINT)"
    budget = d.k.payload_bytes
    kept = d.keep("all_mints", "e", "e IS NOT NULL")
    met = d.keep("all_matches", "e", "e IS NOT NULL")
    return f"""SELECT run_id, {d.size('shown_mints')} AS mints, {d.size('shown_matches')} AS matches, {size('shown_mints', 'shown_matches')} AS bytes, mints_seen, matches_seen FROM (
      SELECT *, CASE WHEN {size('shown_mints', 'matches0')} <= {budget} THEN matches0 ELSE {d.head('matches0', 10)} END AS shown_matches FROM (
        SELECT *, CASE WHEN {size('mints0', 'matches0')} <= {budget} THEN mints0 ELSE {d.last('mints0', 20)} END AS shown_mints FROM (
          SELECT run_id, {d.last('mints_all', d.k.tap_rows)} AS mints0, {d.head('matches_all', d.k.tap_rows)} AS matches0, {d.size('mints_all')} AS mints_seen, {d.size('matches_all')} AS matches_seen FROM (
            SELECT run_id, {kept} AS mints_all, {met} AS matches_all FROM (
              SELECT run_id, {ids('minted')} AS all_mints, {ids('NOT minted')} AS all_matches FROM {acts(d)} AS a GROUP BY run_id) AS l) AS m) AS c) AS s) AS t"""


@sql
def clip_report(d: Dialect) -> str:
    """A line for each clip; critical ones rank first over all of a set."""
    error = f"coalesce({d.percent('err * 100')}, 'no score')"
    text = lambda c: f"CAST({c} AS {d.text})"
    line = f"concat(CASE WHEN criticals > 0 THEN 'CRITICAL ' ELSE '' END, 'clip ', {text('clip')}, ': ', verdict, ', counted ', {text('uniq')}, ' of ', {text('actual')}, ', ', {error})"
    return f"""SELECT half, clip, row_number() OVER (PARTITION BY half ORDER BY CASE WHEN criticals > 0 THEN 0 ELSE 1 END, clip) AS rank, {line} AS line
      FROM ({scores(d)}) AS v"""


def exit_code(verdict: str) -> int:
    """0 for an improvement or no change, 2 for a regression, 3 where nothing can be said."""
    return {"regression": 2, "inconclusive": 3}.get(verdict, 0)


def write_results(scores: DataFrame, path: str) -> None:
    """Scores as JSON, one folder a set, replaced in place."""
    scores.write.mode("overwrite").partitionBy("half").json(path)
