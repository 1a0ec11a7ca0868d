"""Domain views: what operators read, as subqueries in either dialect.

Each view is bound to the given tables unless the dialect names a relation for it
(:func:`turnstile.plans.registry.apply`), which then has the columns listed here
that the operator uses. The given tables have no identities; their mappings give
every operator both outcomes of each of its tests. They say nothing about accuracy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from turnstile.plans.dialect import Dialect

View = Callable[[Dialect], str]


def view(binding: View) -> View:
    """A domain view: the named relation where there is one, else the binding."""

    @wraps(binding)
    def chosen(d: Dialect) -> str:
        own = d.views.get(binding.__name__)
        return f"(SELECT * FROM {own})" if own else binding(d)

    return chosen


# ---------------------------------------------------------------- identities


@view
def templates(d: Dialect) -> str:
    """Templates: id, key, run, label, unit vector, quality, clothing descriptor (null for every seventh), and what was asked of them."""
    v = d.each("embedding", "x", "CAST(x AS DOUBLE)")
    chroma = d.each(d.head("embedding", 48), "x", "CAST(abs(x) AS DOUBLE)")
    return f"""(SELECT vec_id AS id, label, CAST(label * 6 + vec_id % 6 AS BIGINT) AS key, {v} AS vec,
      CAST(40 + vec_id % 80 AS DOUBLE) AS quality, vec_id % 4 AS run_id,
      CASE WHEN vec_id % 7 <> 0 THEN {d.shares(chroma)} END AS appearance,
      label = 9 AS staff, vec_id % 3 = 0 AS forget, vec_id % 3 AS enrolment, vec_id % 9 AS reported
      FROM {d.t('embeddings')} WHERE embedding IS NOT NULL)"""


@view
def probes(d: Dialect) -> str:
    """The query set: every tenth template asks, of whatever run."""
    return f"(SELECT * FROM {templates(d)} AS t0 WHERE id % 10 = 0)"


@view
def gallery(d: Dialect) -> str:
    """Every template answers; a probe leaves itself out where it meets the gallery."""
    return f"(SELECT * FROM {templates(d)} AS t0)"


@view
def encounters(d: Dialect) -> str:
    """Faces of frames in order: run_id, frame, t_ms, n, track and body (null: none), staff, and the template that was seen.

    Six people a run, whose vectors are an axis of their own, more or less blurred by what the table has; clothes are
    mostly their own, now and then another's, mixed or unknown.
    """
    who = "CAST(floor(id / 4.0E0) AS BIGINT) % 6"
    clear = "CASE id * 7 % 5 WHEN 0 THEN 0.3E0 WHEN 1 THEN 0.8E0 WHEN 2 THEN 1.2E0 ELSE 2.0E0 END"
    dims = range(1, 9)
    blurred = d.array(*[f"{d.item('vec', i)} * 3 + CASE WHEN who = {i - 1} THEN clear ELSE 0.0E0 END" for i in dims])
    worn = "(who + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 6"
    other = "(who + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END) % 6"
    look = d.array(*[f"CASE WHEN {worn} = {j} THEN 0.55E0 ELSE 0.0E0 END + CASE WHEN {other} = {j} THEN 0.35E0 ELSE 0.02E0 END" for j in range(6)])
    frame = "CAST(floor(id / 12.0E0) AS BIGINT)"
    return f"""(SELECT run_id, {frame} AS frame, {frame} * 700 AS t_ms, id AS n, CASE WHEN id % 29 <> 0 THEN id * 5 % 3 END AS track, CASE WHEN id % 31 <> 0 THEN id % 12 - id % 12 % 8 % 5 END AS body,
      staff AND id % 2 = 0 AS staff, id, {d.each('raw', 'x', f"x / sqrt({d.dot('raw', 'raw')})")} AS vec, quality, CASE WHEN id % 13 <> 0 THEN {look} END AS appearance
      FROM (SELECT *, {blurred} AS raw FROM (SELECT *, {who} AS who, {clear} AS clear FROM {templates(d)} AS t0) AS t1) AS t2)"""


@view
def run_boxes(d: Dialect) -> str:
    """Boxes of runs' frames: run_id, frame, n, x, y, w, h."""
    return f"(SELECT frame % 64 AS run_id, frame, CAST(n AS BIGINT) AS n, x, y, w, h FROM {boxes(d)} AS b)"


@view
def cannot_link(d: Dialect) -> str:
    """Pairs of keys that must stay apart, smaller first: a, b."""
    return f"""(SELECT DISTINCT least(key, key + 7) AS a, greatest(key, key + 7) AS b
      FROM {templates(d)} AS t0 WHERE key % 3 = 0)"""


@view
def manual(d: Dialect) -> str:
    """People added by hand, without a vector: run_id, id."""
    return f"(SELECT run_id, id FROM {templates(d)} AS t0 WHERE id % 97 = 0)"


@view
def merges(d: Dialect) -> str:
    """Asked merges: keep, gone, only_singleton. Some name a key that isn't there, or a key twice; some are chains,
    rings or two keepers of one key, and some chains lead two keys together that must stay apart."""
    keys = f"(SELECT DISTINCT key FROM {templates(d)} AS t1)"
    return f"""(SELECT CASE WHEN key % 50 = 41 THEN key WHEN key % 30 = 21 THEN -key ELSE key - 1 END AS keep, key AS gone, key % 20 = 11 AS only_singleton
      FROM {keys} AS k1 WHERE key % 10 = 1
      UNION ALL SELECT key - 1, key, false FROM {keys} AS k2 WHERE key % 10 IN (2, 3)
      UNION ALL SELECT CASE WHEN key % 10 = 5 THEN key + 1 ELSE key - 1 END, key, false FROM {keys} AS k3 WHERE key % 20 IN (5, 6)
      UNION ALL SELECT key - 2, key, false FROM {keys} AS k4 WHERE key % 20 = 8
      UNION ALL SELECT key - 1, key, false FROM {keys} AS k5 WHERE key % 20 = 8
      UNION ALL SELECT key + 3, key, false FROM {keys} AS k6 WHERE key % 30 = 24
      UNION ALL SELECT key - 4, key, false FROM {keys} AS k7 WHERE key > 30 AND key % 30 = 1)"""


@view
def marks(d: Dialect) -> str:
    """Keys marked as staff, some with a name: key, name."""
    return f"""(SELECT DISTINCT key, CASE WHEN key % 16 <> 0 THEN concat('staff', CAST(key AS {d.text})) END AS name
      FROM {templates(d)} AS t0 WHERE key % 8 = 0)"""


@view
def tombstones(d: Dialect) -> str:
    """Erased members: key."""
    return f"(SELECT DISTINCT key * 2 AS key FROM {templates(d)} AS t0 WHERE key % 5 = 0)"


# ---------------------------------------------------------------- sightings


@view
def sightings(d: Dialect) -> str:
    """Events as sightings: track, stage, metric value, microseconds, run, properties; and a frame and whether a tap was forced."""
    return f"""(SELECT event_id, user_id AS track, event_type AS stage, value, {d.us('ts')} AS us,
      user_id % 8 AS run_id, props, event_id % 500 AS frame, event_id % 7 = 0 AS forced FROM {d.t('events')})"""


@view
def acts(d: Dialect) -> str:
    """Sightings as acts on tracks: mints and matches with a cosine; body and clothes; whether their clothes clash with the lock's, whether they were folded.

    Acts of a run at one time are a frame.
    """
    return f"""(SELECT run_id, track, event_id, us, event_id % 23 AS key, stage = 'view' OR event_id % 5 = 0 AS minted,
      (event_id * 37 % 100) / 100.0E0 AS cosine, CASE WHEN event_id % 8 <> 3 THEN track END AS body, CASE WHEN event_id % 6 <> 5 THEN (event_id * 13 % 100) / 100.0E0 END AS look,
      event_id % 9 = 0 AS clash, event_id % 4 = 0 AS folded FROM {sightings(d)} AS s0)"""


@view
def steps(d: Dialect) -> str:
    """Changes of the count of people in order: run_id, us, event_id, delta."""
    return f"""(SELECT run_id, us, event_id, CASE stage WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'click' THEN -1
      ELSE CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END END AS delta FROM {sightings(d)} AS s)"""


@view
def feedback(d: Dialect) -> str:
    """Feedback items from conversations: run, a kind by turn, keys for pairs, whether a staff store exists, whether it was applied before."""
    return f"""(SELECT conv_id, turn, conv_id % 4 AS run_id, CASE turn % 6 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'false-match' WHEN 2 THEN 'mark-staff'
      WHEN 3 THEN 'missed' WHEN 4 THEN 'note' ELSE 'unknown' END AS kind,
      CASE WHEN conv_id % 5 <> 0 THEN conv_id % 40 END AS a, CASE WHEN conv_id % 7 <> 0 THEN conv_id % 30 + 1 END AS b,
      conv_id % 3 <> 0 AS has_store, text FROM {d.t('conversations')})"""


@view
def ledger(d: Dialect) -> str:
    """Feedback items that a run has seen: conv_id, turn, settled."""
    return f"(SELECT DISTINCT conv_id, turn, turn % 4 <> 1 AS settled FROM {feedback(d)} AS f0 WHERE conv_id % 2 = 0)"


# ---------------------------------------------------------------- boxes


@view
def boxes(d: Dialect) -> str:
    """Boxes of frames: frame, ordinal (a frame's rows ranked over all columns), x, y, w, h, conf, and whether a box is excluded already."""
    raw = f"""SELECT l_orderkey AS frame, CAST(l_partkey % 120 AS DOUBLE) AS x, CAST(l_suppkey % 60 AS DOUBLE) AS y,
      40 + l_quantity * 2 AS w, 60 + l_extendedprice / 1000 AS h, 1 - l_discount AS conf,
      l_linenumber, l_partkey, l_suppkey, l_tax FROM {d.t('lineitem')}"""
    return f"""(SELECT frame, x, y, w, h, conf, l_tax AS tax, conf < 0.93 AS excluded,
      row_number() OVER (PARTITION BY frame ORDER BY l_linenumber, l_partkey, l_suppkey, x, y, w, h, conf, l_tax) AS n
      FROM ({raw}) AS b0)"""


@view
def tracks(d: Dialect) -> str:
    """Boxes of the tracks that a frame reports: frame, n, x, y, w, h."""
    return f"(SELECT frame, n, x + n * 3 AS x, y + n * 5 AS y, w, h FROM {boxes(d)} AS b WHERE n % 3 <> 0)"


@view
def predictions(d: Dialect) -> str:
    """Predictions with their two scores: frame, n, obj, cls."""
    return f"(SELECT frame, n, conf AS obj, 1 - tax AS cls FROM {boxes(d)} AS b)"


@view
def raw_grid(d: Dialect) -> str:
    """Raw outputs of a detector's grids at strides 8, 16 and 32: n, stride, gx, gy, px, py, pw, ph."""
    part = lambda i: f"CAST({d.item('embedding', i)} AS DOUBLE)"
    return f"""(SELECT vec_id AS n, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride, vec_id % 52 AS gx, vec_id % 40 AS gy,
      {part(1)} AS px, {part(2)} AS py, {part(3)} AS pw, {part(4)} AS ph FROM {d.t('embeddings')} WHERE embedding IS NOT NULL)"""


@view
def images(d: Dialect) -> str:
    """Raw pixels, three bytes each, in rows of 48: image_id, pixels, width, height. Spark only: bytes of pages stand for them."""
    return f"""(SELECT page_id AS image_id, substring(CAST(html AS BINARY), 1, CAST(octet_length(html) DIV 144 AS INT) * 144) AS pixels, 48 AS width, CAST(octet_length(html) DIV 144 AS INT) AS height
      FROM {d.t('pages')} WHERE octet_length(html) >= 144)"""


@view
def wire(d: Dialect) -> str:
    """Frames as they come over the wire, in base64: image_id, data. Spark only: pages behind a JPEG's header of a known size; some have no header, some aren't base64."""
    head = "CASE WHEN page_id % 5 <> 0 THEN concat('FFD8FFE000046162FFC0001108', lpad(hex(page_id % 300 + 1), 4, '0'), lpad(hex(page_id % 500 + 1), 4, '0'), '03') ELSE '' END"
    return f"(SELECT page_id AS image_id, CASE WHEN page_id % 7 = 3 THEN '*no base64*' ELSE base64(unhex(concat({head}, hex(html)))) END AS data FROM {d.t('pages')} WHERE html IS NOT NULL)"


@view
def lettered(d: Dialect) -> str:
    """Boxes by their centres in a letterboxed image: frame, n, cx, cy, w, h, scale, and the frame's size fw, fh."""
    return f"(SELECT frame, n, x AS cx, y AS cy, w, h, 0.65E0 AS scale, 1920.0E0 AS fw, 1080.0E0 AS fh FROM {boxes(d)} AS b)"


@view
def loose_boxes(d: Dialect) -> str:
    """Boxes that may reach over the frame's edges: frame, n, x, y, w, h, fw, fh."""
    return f"(SELECT frame, n, x - 50 AS x, y - 20 AS y, w, h, 100.0E0 AS fw, 80.0E0 AS fh FROM {boxes(d)} AS b)"


@view
def faces(d: Dialect) -> str:
    """Faces: the upper part of every other box, with the signals of the gate, the width in pixels and the frame's size (null: unknown)."""
    return f"""(SELECT frame, n, x + w * 0.3 AS x, y + h * 0.1 AS y, w * 0.4 AS w, h * 0.3 AS h, conf, w * 0.8 AS width_px,
      CASE WHEN n % 5 <> 0 THEN w * 0.2 END AS ied, CASE WHEN n % 4 <> 0 THEN conf END AS frontality,
      CASE WHEN n % 3 <> 0 THEN tax * 1000 END AS sharpness,
      CASE WHEN frame % 11 <> 0 THEN 160.0E0 END AS fw, CASE WHEN frame % 11 <> 0 THEN 120.0E0 END AS fh
      FROM {boxes(d)} AS b1 WHERE n % 2 = 1)"""


@view
def landmarks(d: Dialect) -> str:
    """Eyes and nose of faces: frame, n, lx, ly, rx, ry (eyes), nx (nose)."""
    return f"""(SELECT frame, n, x + w / 3 AS lx, y + h / 3 AS ly, x + w * 2 / 3 AS rx, y + h / 3 + h / 20 AS ry, x + w * (0.45 + conf % 0.1) AS nx
      FROM {faces(d)} AS f)"""


@view
def marks5(d: Dialect) -> str:
    """Landmarks of faces, five a face: frame, n, i (eyes, nose, corners of the mouth), x, y."""
    at = (("0.3", "0.35"), ("0.7", "0.35"), ("0.5", "0.6"), ("0.35", "0.8"), ("0.65", "0.8"))
    points = d.array(*[d.struct(i=str(i), x=f"x + w * {a}", y=f"y + h * {b}") for i, (a, b) in enumerate(at, 1)])
    return f"(SELECT frame, n, CAST(p.i AS BIGINT) AS i, p.x AS x, p.y AS y FROM (SELECT frame, n, p FROM {faces(d)} AS f {d.rows(points, 'e', 'p')}) AS m)"


@view
def verdicts(d: Dialect) -> str:
    """Verdicts of frames: run, a key, a cosine, a body (some boxes hold two faces, some faces stand in none) and its clothes for every face."""
    return f"""(SELECT frame % 8 AS run_id, frame, n, CAST(floor(x) AS BIGINT) % 4 AS key, conf AS cosine, CASE WHEN n % 7 <> 6 THEN n - n % 3 % 2 END AS body,
      CASE WHEN n % 6 <> 5 THEN tax * 10 END AS look, n % 5 = 0 AS minted, frame % 13 = 0 AS staff FROM {boxes(d)} AS b0)"""


@view
def frames(d: Dialect) -> str:
    """Frames of runs: seq, run_id, us, cost, the ledger's slot, how the run ended there, priority."""
    return f"""(SELECT o_orderkey AS seq, o_custkey % 8 AS run_id, {d.us('o_orderdate')} AS us, o_totalprice AS cost, o_orderkey % 700 AS slot,
      CASE o_orderstatus WHEN 'F' THEN 'source-ended' WHEN 'O' THEN 'operator-stopped' ELSE 'source-stalled' END AS end_reason, o_orderpriority AS priority FROM {d.t('orders')})"""


@view
def stores(d: Dialect) -> str:
    """Galleries and staff stores with their last use, and the time it is: run_id, staff, last_us, now_us."""
    return f"""(SELECT run_id, run_id % 4 = 0 AS staff, max(us) AS last_us, (SELECT max(us) FROM {frames(d)} AS f1) AS now_us FROM {frames(d)} AS f0 GROUP BY run_id)"""


@view
def tallies(d: Dialect) -> str:
    """What became of a frame's faces: frame, faces, kept, enrolled, matched, minted, near_misses."""
    return f"""(SELECT frame, count(*) AS faces, count(CASE WHEN conf >= 0.92 THEN 1 END) AS kept, CASE WHEN count(*) >= 4 THEN count(CASE WHEN conf >= 0.99 THEN 1 END) ELSE 0 END AS enrolled,
      count(CASE WHEN conf >= 0.98 THEN 1 END) AS matched, count(CASE WHEN conf >= 0.96 THEN 1 END) AS minted, count(CASE WHEN conf >= 0.94 THEN 1 END) AS near_misses
      FROM {boxes(d)} AS b0 GROUP BY frame)"""


@view
def enrolments(d: Dialect) -> str:
    """Faces of enrolment runs: run_id, frame, n, conf, and whether the gate kept the face."""
    return f"(SELECT frame % 8 AS run_id, frame, n, conf, conf >= 0.91 AS kept FROM {boxes(d)} AS b0)"


@view
def later_boxes(d: Dialect) -> str:
    """Boxes of the frame after each frame: frame (the earlier one), n, x, y, w, h."""
    after = f"(SELECT frame, lead(frame) OVER (PARTITION BY frame % 64 ORDER BY frame) AS later FROM (SELECT DISTINCT frame FROM {boxes(d)} AS b1) AS f1)"
    return f"(SELECT f.frame, b.n, b.x, b.y, b.w, b.h FROM {after} AS f JOIN {boxes(d)} AS b ON b.frame = f.later)"


@view
def taps(d: Dialect) -> str:
    """Occasions for a tap in order: track, event_id, us, what it costs (microseconds), forced."""
    return f"(SELECT track, event_id, us, CAST(floor(value) AS BIGINT) * 60000000 AS cost_us, forced FROM {sightings(d)} AS s0)"


@view
def watched(d: Dialect) -> str:
    """Until when each run was watched: run_id, until_us."""
    return f"(SELECT run_id, max(max(us)) OVER () AS until_us FROM {sightings(d)} AS s0 GROUP BY run_id)"


#: Zones: a square, a triangle and a concave polygon, in the boxes' coordinates.
ZONES: tuple[tuple[str, int, str, tuple[tuple[float, float], ...]], ...] = (
    ("door", 1, "faces", ((0, 0), (60, 0), (60, 60), (0, 60))),
    ("till", 2, "detections", ((80, 10), (160, 10), (120, 90))),
    ("hall", 3, "faces", ((40, 70), (150, 70), (150, 150), (95, 100), (40, 150))),
)


@view
def corners(d: Dialect) -> str:
    """Zones by their corners in order: label, zn (the zones' order), mode, i (from 1), x, y."""
    rows = [f"('{label}', {n}, '{mode}', {i}, {x:.1f}, {y:.1f})" for label, n, mode, points in ZONES for i, (x, y) in enumerate(points, 1)]
    return f"""(SELECT label, CAST(zn AS BIGINT) AS zn, mode, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
      FROM (VALUES {', '.join(rows)}) AS z(label, zn, mode, i, x, y))"""


# ---------------------------------------------------------------- evaluation


@view
def runs(d: Dialect) -> str:
    """Runs before and after a change: one per customer group and half of the orders.

    clip, half, frames (of the stage; result_frames count where it has none), person_boxes, faces, passing, embed_row (whether the embedder
    reported), embeds (null: not told), matches, uniq, end_reason, face_width, ingest_fps, count_fps.
    """
    return f"""(SELECT o_custkey % 25 AS clip, o_orderkey % 2 AS half, CASE WHEN o_custkey % 25 = 17 THEN CAST(0 AS BIGINT) ELSE count(*) END AS frames,
      count(*) AS result_frames, CAST(floor(sum(o_totalprice) / 50000) AS BIGINT) AS person_boxes,
      CAST(floor(sum(o_totalprice) / 90000) AS BIGINT) AS faces,
      CASE WHEN o_custkey % 25 = 7 THEN CAST(0 AS BIGINT) ELSE CAST(floor(sum(o_totalprice) / 200000) AS BIGINT) END AS passing,
      o_custkey % 25 <> 19 AS embed_row,
      CASE WHEN o_custkey % 25 = 3 THEN NULL ELSE CAST(floor(sum(o_totalprice) / 200000) AS BIGINT) END AS embeds,
      CAST(floor(sum(o_totalprice) / 210000) AS BIGINT) AS matches,
      CASE WHEN o_custkey % 25 = 11 THEN CAST(0 AS BIGINT) ELSE count(DISTINCT o_custkey) END AS uniq,
      CASE WHEN o_custkey % 25 = 5 THEN 'stalled' ELSE 'source-ended' END AS end_reason,
      round(min(o_totalprice) / 100, 1) AS face_width, CASE WHEN o_custkey % 25 <> 9 THEN round(count(*) / 8.0E0, 3) END AS ingest_fps, round(count(*) / 16.0E0, 3) AS count_fps
      FROM {d.t('orders')} WHERE o_orderkey % 2 = 0 OR NOT o_custkey % 25 IN (20, 21) GROUP BY o_custkey % 25, o_orderkey % 2)"""


@view
def clips(d: Dialect) -> str:
    """Clips with their path, true counts and tags."""
    return f"""(SELECT c_custkey % 25 AS clip, concat('/clips/', CAST(c_custkey % 25 AS {d.text}), '.mp4') AS path, count(*) AS actual,
      {d.array("CASE WHEN c_custkey % 25 % 2 = 0 THEN 'surge' ELSE 'staff' END", "CASE WHEN c_custkey % 25 % 3 = 0 THEN 'veil' ELSE 'evening-light' END")} AS tags
      FROM {d.t('customer')} GROUP BY c_custkey % 25)"""


@view
def prior(d: Dialect) -> str:
    """Scores of an earlier run: clip, path, actual, tags, envelope (null: unknown). Some clips changed since."""
    return f"""(SELECT clip, CASE WHEN clip % 7 = 2 THEN '/elsewhere.mp4' ELSE path END AS path, actual + CASE WHEN clip % 6 = 0 THEN 1 ELSE 0 END AS actual,
      CASE WHEN clip % 9 = 4 THEN {d.array("'veil'")} ELSE tags END AS tags,
      CASE WHEN clip % 4 = 0 THEN NULL WHEN clip % 4 = 1 THEN 0.1E0 ELSE 0.05E0 END AS envelope
      FROM {clips(d)} AS c0 WHERE clip % 5 <> 0)"""


@view
def waivers(d: Dialect) -> str:
    """Clips that may be missing after the change: clip."""
    return "(SELECT CAST(clip AS BIGINT) AS clip FROM (VALUES (20)) AS w(clip))"


@view
def manifest(d: Dialect) -> str:
    """A manifest as read, faults and all: clip, label, path, actual, tags."""
    bad = d.array("'surge'", "'fog'")
    return f"""(SELECT clip, CAST(clip % 24 AS {d.text}) AS label, CASE WHEN clip % 6 = 1 THEN 'clips/a.mp4' ELSE path END AS path,
      actual - CASE WHEN clip % 7 = 3 THEN actual ELSE 0 END AS actual, CASE WHEN clip % 5 = 3 THEN {bad} ELSE {d.array("'surge'", "'veil'")} END AS tags
      FROM {clips(d)} AS c)"""


# ---------------------------------------------------------------- texts


@view
def sources(d: Dialect) -> str:
    """Addresses of cameras: page_id, u."""
    return f"""(SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN 'rtsp://user:secret@cam' ELSE 'https://cam' END,
      CAST(page_id % 9 AS {d.text}), '/live?token=', CAST(page_id AS {d.text})) AS u FROM {d.t('pages')})"""


@view
def labels_given(d: Dialect) -> str:
    """Names that people give: p_partkey, p_name."""
    return f"(SELECT p_partkey, p_name FROM {d.t('part')})"


@view
def payloads(d: Dialect) -> str:
    """Payloads to be sent: conv_id, turn, text."""
    return f"(SELECT conv_id, turn, text FROM {d.t('conversations')})"
