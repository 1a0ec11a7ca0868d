"""Boxes, zones and their joins: all within a frame, so frames are the join key."""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import boxes, corners, faces, lettered, loose_boxes, marks5, predictions, raw_grid, tracks


def iou(a: str, b: str) -> str:
    """Intersection over union of two boxes; 0 where a box has no area."""
    side = lambda x, w: f"greatest(0.0, least({a}.{x} + {a}.{w}, {b}.{x} + {b}.{w}) - greatest({a}.{x}, {b}.{x}))"
    both = f"({side('x', 'w')} * {side('y', 'h')})"
    union = f"({a}.w * {a}.h + {b}.w * {b}.h - {both})"
    return f"(CASE WHEN {a}.w * {a}.h <= 0 OR {b}.w * {b}.h <= 0 OR {union} <= 0 THEN 0.0 ELSE {both} / {union} END)"


@sql
def iou_pairs(d: Dialect) -> str:
    return f"""SELECT frame, n_a, n_b, round(iou, 6) AS iou FROM (SELECT a.frame, a.n AS n_a, b.n AS n_b, {iou('a', 'b')} AS iou
      FROM {boxes(d)} AS a JOIN {boxes(d)} AS b ON a.frame = b.frame AND a.n < b.n) AS p WHERE iou >= {d.k.track_iou}"""


@sql
def score_filter(d: Dialect) -> str:
    return f"SELECT frame, n, round(obj * cls, 6) AS score FROM {predictions(d)} AS b WHERE obj * cls >= {d.k.detect_score}"


@sql
def grid_decode(d: Dialect) -> str:
    """Anchors of a grid: centre and size of each prediction."""
    return f"""SELECT n, round((px + gx) * stride, 6) AS cx, round((py + gy) * stride, 6) AS cy,
      round(exp(pw) * stride, 6) AS w, round(exp(ph) * stride, 6) AS h FROM {raw_grid(d)} AS g"""


@sql
def unletterbox(d: Dialect) -> str:
    """Centre boxes to corners, scaled back, clamped to the frame and rounded to a tenth."""
    tidy = lambda x, most: f"floor(greatest(0.0, least({most}, ({x}) / scale)) * 10 + 0.5) / 10"
    return f"""SELECT frame, n, {tidy('cx - w / 2', 'fw')} AS x1, {tidy('cy - h / 2', 'fh')} AS y1,
      {tidy('cx + w / 2', 'fw')} AS x2, {tidy('cy + h / 2', 'fh')} AS y2 FROM {lettered(d)} AS b"""


def _zones(d: Dialect) -> str:
    """All zones as one array, each with the edges from every corner to the one before it: a dimension of a few rows."""
    edge = d.struct(xi="x", yi="y", xj="px", yj="py")
    before = lambda c: f"coalesce(lag({c}) OVER (PARTITION BY zn ORDER BY i), last_value({c}) OVER (PARTITION BY zn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    edges = f"""SELECT label, zn, mode, {d.listed(edge)} AS edges FROM (
      SELECT label, zn, mode, x, y, {before('x')} AS px, {before('y')} AS py FROM {corners(d)} AS c0) AS c1 GROUP BY label, zn, mode"""
    whole = d.fail_unless(f"{d.size('edges')} >= 3", "a zone needs three corners", "edges")
    return f"(SELECT {d.listed(d.struct(label='label', zn='zn', mode='mode', edges=whole))} FROM ({edges}) AS e)"


def _inside(d: Dialect, points: str, key: str, *modes: str) -> str:
    """(key, hits) of points: the zones that hold them, an odd number of edges to one side.

    The zones come along as one constant array, so a point is decided in its row.
    """
    crosses = "((e.yi > py) <> (e.yj > py) AND px < (e.xj - e.xi) * (py - e.yi) / (CASE WHEN e.yj = e.yi THEN 1.0 ELSE e.yj - e.yi END) + e.xi)"
    odd = f"{d.size(d.keep('z.edges', 'e', crosses))} % 2 = 1"
    named = ", ".join(f"'{m}'" for m in modes)
    held = d.keep("zones", "z", f"z.mode IN ({named}) AND {odd}")
    return f"SELECT {key}, {held} AS hits FROM (SELECT {key}, px, py, {_zones(d)} AS zones FROM ({points}) AS pt) AS pz"


@sql
def point_in_polygon(d: Dialect) -> str:
    points = f"SELECT frame, n, x AS px, y AS py FROM {boxes(d)} AS b"
    return f"SELECT frame, n, hit.label AS label FROM (SELECT frame, n, hit FROM ({_inside(d, points, 'frame, n', 'faces', 'detections')}) AS t {d.rows('t.hits', 'u', 'hit')}) AS h"


@sql
def zone_filter(d: Dialect) -> str:
    """Faces are flagged with the first zone their centre is in; frames without dimensions are unmeasured."""
    points = f"SELECT frame, n, fw, CASE WHEN fw IS NOT NULL THEN x + w / 2 END AS px, y + h / 2 AS py FROM {faces(d)} AS f0"
    first = f"CASE WHEN fw IS NOT NULL AND {d.size('hits')} > 0 THEN {d.least_by('hits', 'zn')}.label END"
    return f"""SELECT frame, n, zone, zone IS NOT NULL AS excluded, unmeasured FROM (
      SELECT frame, n, {first} AS zone, fw IS NULL AS unmeasured FROM ({_inside(d, points, 'frame, n, fw', 'faces')}) AS i) AS f"""


@sql
def zone_detections(d: Dialect) -> str:
    """Person boxes that a detections zone drops before tracking, counted per frame."""
    points = f"SELECT frame, n, x + w / 2 AS px, y + h / 2 AS py FROM {boxes(d)} AS b0"
    return f"""SELECT frame, count(*) AS persons, count(CASE WHEN {d.size('hits')} > 0 THEN 1 END) AS persons_zoned
      FROM ({_inside(d, points, 'frame, n', 'detections')}) AS i GROUP BY frame"""


@sql
def zone_mark(d: Dialect) -> str:
    """Display only: boxes in any zone, except those already excluded."""
    points = f"SELECT frame, n, x + w / 2 AS px, y + h / 2 AS py FROM {boxes(d)} AS b0 WHERE NOT excluded"
    return f"SELECT frame, n, true AS in_zone FROM ({_inside(d, points, 'frame, n', 'faces', 'detections')}) AS i WHERE {d.size('hits')} > 0"


def _held(d: Dialect, rows: str) -> str:
    """Each face with the box that holds its centre; ties go to the nearest centre, then the first box."""
    return f"""SELECT frame, face, box FROM (SELECT f.frame, f.n AS face, b.n AS box, row_number() OVER (PARTITION BY f.frame, f.n ORDER BY
        (b.x + b.w / 2 - f.x - f.w / 2) * (b.x + b.w / 2 - f.x - f.w / 2) + (b.y + b.h / 2 - f.y - f.h / 2) * (b.y + b.h / 2 - f.y - f.h / 2), b.n) AS rn
      FROM {faces(d)} AS f JOIN {rows} AS b ON f.frame = b.frame AND f.x + f.w / 2 BETWEEN b.x AND b.x + b.w
        AND f.y + f.h / 2 BETWEEN b.y AND b.y + b.h) AS t WHERE rn = 1"""


@sql
def face_track_assoc(d: Dialect) -> str:
    """The track a face belongs to: evidence about one person over time."""
    return _held(d, tracks(d))


@sql
def face_body_assoc(d: Dialect) -> str:
    """The raw person box a face belongs to: its extent in this frame, where a track's box may be a guess."""
    return _held(d, boxes(d))


@sql
def clamp_box(d: Dialect) -> str:
    """Corners rounded half to even and clamped to the frame; null where nothing is left."""
    x1, y1 = f"greatest(0.0, {d.half_even('x')})", f"greatest(0.0, {d.half_even('y')})"
    x2, y2 = f"least(fw, {d.half_even('x + w')})", f"least(fh, {d.half_even('y + h')})"
    return f"""SELECT frame, n, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2
      FROM (SELECT *, x2 > x1 AND y2 > y1 AS ok FROM (SELECT frame, n, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM {loose_boxes(d)} AS b) AS c) AS k"""


@sql
def offset_face(d: Dialect) -> str:
    """Faces moved from their crop to the frame."""
    return f"""SELECT f.frame, f.n, round(f.x + b.x, 6) AS x, round(f.y + b.y, 6) AS y, f.w, f.h FROM {faces(d)} AS f
      JOIN {boxes(d)} AS b ON b.frame = f.frame AND b.n = f.n"""


@sql
def offset_landmarks(d: Dialect) -> str:
    """Landmarks move with their face from its crop to the frame."""
    return f"""SELECT m.frame, m.n, m.i, round(m.x + b.x, 6) AS x, round(m.y + b.y, 6) AS y FROM {marks5(d)} AS m
      JOIN {boxes(d)} AS b ON b.frame = m.frame AND b.n = m.n"""


@sql
def torso_rect(d: Dialect) -> str:
    """Below the face, to 2.5 face heights or the box's end, 15 % in from the sides; null under 24 pixels."""
    x1, x2 = d.half_even("b.x + 0.15 * b.w"), d.half_even("b.x + 0.85 * b.w")
    y1, y2 = d.half_even("f.y + f.h"), d.half_even("least(f.y + f.h + 2.5 * f.h, b.y + b.h)")
    return f"""SELECT frame, n, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2
      FROM (SELECT *, x2 - x1 >= 24 AND y2 - y1 >= 24 AS ok FROM (SELECT f.frame, f.n, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2
        FROM {faces(d)} AS f JOIN {boxes(d)} AS b ON b.frame = f.frame AND b.n = f.n) AS c) AS k"""


@sql
def face_crop_rect(d: Dialect) -> str:
    """The face with 35 % around it, clamped; null under two pixels; unclamped to the right and below where the frame's size is unknown."""
    return f"""SELECT frame, n, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2
      FROM (SELECT *, x2 - x1 >= 2 AND y2 - y1 >= 2 AS ok FROM (SELECT frame, n, greatest(0.0, {d.half_even('x - 0.35 * w')}) AS x1,
        greatest(0.0, {d.half_even('y - 0.35 * h')}) AS y1, least(fw, {d.half_even('x + 1.35 * w')}) AS x2, least(fh, {d.half_even('y + 1.35 * h')}) AS y2
        FROM {faces(d)} AS f) AS c) AS k"""


def _greedy(d: Dialect, order: str, limit: str, rows_of: str | None = None) -> str:
    """Boxes in order, each kept if it overlaps no kept one by more than ``limit``."""
    typed = "CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(n AS BIGINT) AS n"
    rows = f"SELECT frame, {typed}, row_number() OVER (PARTITION BY frame ORDER BY {order}) AS k FROM {rows_of or boxes(d)} AS b"
    if d.spark:
        hit = f"k -> {iou('k', 'c')} <= {limit}"
        return f"""SELECT frame, kept.n AS n FROM (SELECT frame, explode(aggregate(array_sort(collect_list(struct(k, x, y, w, h, n))),
            CAST(array() AS ARRAY<STRUCT<k: INT, x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE, n: BIGINT>>),
            (a, c) -> CASE WHEN forall(a, {hit}) THEN concat(a, array(c)) ELSE a END)) AS kept FROM ({rows}) AS r GROUP BY frame) AS e"""
    return f"""WITH RECURSIVE r AS ({rows}), step AS (
      SELECT frame, 1::BIGINT AS k, [struct_pack(x := x, y := y, w := w, h := h, n := n)] AS kept FROM r WHERE k = 1
      UNION ALL
      SELECT r.frame, r.k, CASE WHEN len(list_filter(s.kept, lambda q: {iou('q', 'r')} > {limit})) = 0
        THEN list_append(s.kept, struct_pack(x := r.x, y := r.y, w := r.w, h := r.h, n := r.n)) ELSE s.kept END
      FROM step AS s JOIN r ON r.frame = s.frame AND r.k = s.k + 1)
      SELECT frame, u.n AS n FROM (SELECT frame, unnest(kept) AS u FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY k DESC) AS last FROM step) AS f WHERE last = 1) AS g"""


@sql
def nms(d: Dialect) -> str:
    """Greedy by score; a box falls if it overlaps a kept one by more than the threshold."""
    return _greedy(d, "conf DESC, n", str(d.k.nms_iou))


@sql
def dedupe_boxes(d: Dialect) -> str:
    """Greedy in the order of the input."""
    return _greedy(d, "n", str(d.k.dedupe_iou))


@sql
def face_dedupe(d: Dialect) -> str:
    """Faces of a frame found twice: greedy by confidence, best first."""
    return _greedy(d, "conf DESC, n", str(d.k.dedupe_iou), faces(d))


@sql
def search_region(d: Dialect) -> str:
    """Where faces are looked for: a frame's raw boxes first, then its tracks', without those that overlap an earlier one."""
    both = f"""(SELECT frame, x, y, w, h, 2 * n AS n, 0 AS tracked FROM {boxes(d)} AS b1
      UNION ALL SELECT frame, x, y, w, h, 2 * n + 1 AS n, 1 AS tracked FROM {tracks(d)} AS t1)"""
    found = _greedy(d, "tracked, n", str(d.k.dedupe_iou), both)
    return f"SELECT frame, CAST(floor(n / 2.0E0) AS BIGINT) AS n, n % 2 = 1 AS tracked FROM ({found}) AS g"


@sql
def zone_corners(d: Dialect) -> str:
    """Zones need three corners at least."""
    return f"SELECT label, count(*) AS corners, count(*) >= 3 AS valid FROM {corners(d)} AS c GROUP BY label"
