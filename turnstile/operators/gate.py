"""The quality gate: the first failing floor rejects; an absent signal never does, it is counted."""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import faces, landmarks, marks5


def judged(d: Dialect) -> str:
    """Faces with the first floor that rejects them, and how many signals of armed floors they lack."""
    k = d.k
    absent = " + ".join(f"CASE WHEN {floor} > 0 AND {signal} IS NULL THEN 1 ELSE 0 END" for signal, floor in (("ied", k.ied_floor), ("frontality", k.frontality_floor), ("sharpness", k.sharpness_floor)))
    return f"""SELECT *, CASE WHEN width_px < {k.sub_canon_width} THEN 'width' WHEN ied < {k.ied_floor} THEN 'ied' WHEN frontality < {k.frontality_floor} THEN 'frontality'
      WHEN sharpness < {k.sharpness_floor} THEN 'sharpness' END AS rejected_by, {absent} AS missing FROM {faces(d)} AS f"""


@sql
def width_band(d: Dialect) -> str:
    k = d.k
    return f"""SELECT frame, n, w, CASE WHEN width_px >= {k.canon_width} THEN 'ok' WHEN width_px >= {k.sub_canon_width} THEN 'sub-canon' ELSE 'reject' END AS width_class,
      CASE WHEN width_px < {k.sub_canon_width} THEN 'gated' WHEN width_px < {k.canon_width} THEN 'sub-canon' ELSE 'canon' END AS band FROM {faces(d)} AS f"""


@sql
def quality_gate(d: Dialect) -> str:
    return f"SELECT frame, n, rejected_by, rejected_by IS NULL AS kept, missing > 0 AS unmeasured FROM ({judged(d)}) AS j"


@sql
def gate_rollup(d: Dialect) -> str:
    return f"SELECT frame, coalesce(rejected_by, 'kept') AS reason, count(*) AS faces FROM ({judged(d)}) AS j GROUP BY frame, coalesce(rejected_by, 'kept')"


@sql
def gate_reasons(d: Dialect) -> str:
    """One counter per reason, over all frames."""
    counts = ", ".join(f"count(CASE WHEN rejected_by = '{r}' THEN 1 END) AS gated_{r}" for r in ("width", "ied", "frontality", "sharpness"))
    return f"SELECT count(*) AS faces, count(CASE WHEN rejected_by IS NULL THEN 1 END) AS kept, {counts} FROM ({judged(d)}) AS j"


@sql
def gate_unmeasured(d: Dialect) -> str:
    """Faces, not signals, that lack a signal of an armed floor."""
    return f"SELECT frame, count(CASE WHEN missing > 0 THEN 1 END) AS unmeasured, count(*) AS faces FROM ({judged(d)}) AS j GROUP BY frame"


@sql
def armed_floors(d: Dialect) -> str:
    """The floors that are armed, and how many faces came without the signal that each looks at."""
    k = d.k
    floors = (("width", "width_px", k.sub_canon_width), ("ied", "ied", k.ied_floor), ("frontality", "frontality", k.frontality_floor), ("sharpness", "sharpness", k.sharpness_floor))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({v} AS DOUBLE) AS floor_at, count(*) AS faces, count(*) - count({c}) AS unmeasured FROM {faces(d)} AS f" for n, c, v in floors)
    return f"SELECT name, floor_at, faces, unmeasured FROM ({rows}) AS r WHERE floor_at > 0"


@sql
def ied_frontality(d: Dialect) -> str:
    """Distance of the eyes, and how far the nose is off their middle."""
    eyes = "sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))"
    nose = "abs(nx - (lx + rx) / 2)"
    tidy = lambda x, n: f"floor(({x}) * {10**n} + 0.5) / {10**n}"
    return f"""SELECT frame, n, {tidy(eyes, 1)} AS ied_px, CASE WHEN {eyes} = 0 THEN 0.0 ELSE {tidy(f'greatest(0.0, 1 - {nose} / {eyes})', 3)} END AS frontal
      FROM {landmarks(d)} AS f"""


@sql
def enrol_score(d: Dialect) -> str:
    """Eye distance times frontality where both are present, else the width."""
    return f"SELECT frame, n, round(coalesce(ied * frontality, w), 6) AS score FROM {faces(d)} AS f"


@sql
def face_row_pack(d: Dialect) -> str:
    """Box, five landmarks and score as one row of 15 numbers; a face with other than five landmarks is an error."""
    marks = f"(SELECT frame, n, {d.sorted_list(d.struct(i='i', x='x', y='y'), 'i')} AS marks FROM {marks5(d)} AS m0 GROUP BY frame, n)"
    at = lambda i, c: f"{d.item('marks', i)}.{c}"
    five = d.fail_unless(f"{d.size('marks')} = 5", "a face has five landmarks", d.array("x", "y", "w", "h", *[at(i, c) for i in range(1, 6) for c in "xy"], "conf"))
    return f"""SELECT frame, n, {d.size('packed')} AS numbers, {d.item('packed', 5)} AS eye_x, {d.item('packed', 14)} AS mouth_y, {d.item('packed', 15)} AS conf FROM (
      SELECT f.frame, f.n, {five} AS packed FROM {faces(d)} AS f JOIN {marks} AS k ON k.frame = f.frame AND k.n = f.n) AS p"""


@sql
def sub_canon_share(d: Dialect) -> str:
    """The share of kept faces below the canonical width; 0 where none is kept."""
    return f"""SELECT frame, CASE WHEN count(*) = count(rejected_by) THEN 0.0
      ELSE round(count(CASE WHEN rejected_by IS NULL AND width_px < {d.k.canon_width} THEN 1 END) * 1.0E0 / (count(*) - count(rejected_by)), 6) END AS share
      FROM ({judged(d)}) AS j GROUP BY frame"""


@sql
def face_sizes(d: Dialect) -> str:
    """Sizes of the faces seen and of those that passed: count, least, mean and most of each signal, null where none has it."""
    parts = []
    for who, where in (("detected", "true"), ("passed", "rejected_by IS NULL")):
        for signal in ("width_px", "ied", "frontality") if who == "detected" else ("width_px",):
            parts.append(f"""SELECT '{who}' AS who, '{signal}' AS signal, count({signal}) AS n, min({signal}) AS low, round(avg({signal}), 6) AS mean, max({signal}) AS high
      FROM ({judged(d)}) AS j WHERE {where}""")
    return "\n      UNION ALL ".join(parts)
