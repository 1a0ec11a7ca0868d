"""Vector search over templates, and what a gallery learns.

Probes are a stated query set and meet all other templates, of every run, so staff
of a site are found whatever run enrolled them. Spark computes the best rows of keys,
siblings and clothes with matrices (:mod:`turnstile.operators.blocks`) and the texts read
them as relations; the oracle's texts join all pairs, in ``BLOCKS`` blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstile.operators.blocks import best_by_key, closest_siblings, likeness, look_pairs
from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import Prepare, cut, sql, sql_over
from turnstile.sources.bindings import View, cannot_link, gallery, manual, probes, templates


#: Blocks of answering rows: the parts of a search.
BLOCKS = 16


def _searching(apart: bool = False, staff: bool = False, looks: bool = False, siblings: bool = False) -> Prepare:
    """What a search's text reads in Spark: ``met``, the best rows of each probe's best keys; with ``looks`` the clothes, with ``siblings`` a key's closest rows."""

    def prepare(spark: SparkSession, d: Dialect) -> dict[str, DataFrame]:
        asking, answering = (spark.sql(f"SELECT * FROM {v(d)} AS v0") for v in (probes, gallery))
        out = {"met": cut(best_by_key(asking, answering, apart, staff))}
        if looks:
            top = out["met"].selectExpr("probe", "key", "row_number() OVER (PARTITION BY probe ORDER BY cosine DESC, id) AS rn").where("rn = 1")
            out["alike"] = likeness(top.select("probe", "key"), asking, answering)
        if siblings:
            out["closest"] = closest_siblings(answering)
        return out

    return prepare


def _siblings(spark: SparkSession, d: Dialect) -> dict[str, DataFrame]:
    return {"closest": cut(closest_siblings(spark.sql(f"SELECT * FROM {templates(d)} AS v0")))}


def _asking(d: Dialect, rows: str) -> str:
    """Rows once a block."""
    return f"(SELECT a0.*, block FROM {rows} AS a0 {d.rows(d.numbers('0', str(BLOCKS - 1)), 'k0', 'block')})"


def _answering(rows: str) -> str:
    """Rows with their block."""
    return f"(SELECT *, (id % {BLOCKS} + {BLOCKS}) % {BLOCKS} AS block FROM {rows} AS a1)"


def _scored(d: Dialect, extra: str = "", staff: bool = False) -> str:
    """Every probe with every other template, and their cosine (vectors are unit)."""
    return f"""SELECT p.id AS probe, p.key AS probe_key, g.id AS id, g.key AS key{', g.staff AS staff' if staff else ''}, {d.dot('p.vec', 'g.vec')} AS cosine
      FROM {_asking(d, probes(d))} AS p JOIN {_answering(gallery(d))} AS g ON g.block = p.block AND g.id <> p.id {extra}"""


def _by_key(d: Dialect, extra: str = "", staff: bool = False) -> str:
    """The best row of each key for each probe; ties go to the lowest id. With ``staff`` also the best of its staff rows."""
    if "met" in d.views:
        return f"SELECT * FROM {d.views['met']}"
    top = "struct(cosine AS cosine, -id AS back)" if d.spark else "struct_pack(cosine := cosine, back := -id)"
    more, also = (", max(CASE WHEN staff THEN cosine END) AS own_staff", ", own_staff") if staff else ("", "")
    return f"""SELECT probe, probe_key, key, top.cosine AS cosine, -top.back AS id{also}
      FROM (SELECT probe, probe_key, key, max({top}) AS top{more} FROM ({_scored(d, extra, staff)}) AS s0 GROUP BY probe, probe_key, key) AS s1"""


def _best(d: Dialect, extra: str = "", staff: bool = False) -> str:
    """Each probe's best row, and the best row of any other key; with ``staff`` the best cosine of staff."""
    order = "OVER (PARTITION BY probe ORDER BY cosine DESC, id)"
    also = ", max(own_staff) OVER (PARTITION BY probe) AS staff" if staff else ""
    return f"""SELECT * FROM (SELECT *, row_number() {order} AS rn, lead(key) {order} AS rival, lead(cosine) {order} AS rival_cosine{also}
      FROM ({_by_key(d, extra, staff)}) AS b0) AS b1 WHERE rn = 1"""


@sql_over(_searching())
def cosine_top1(d: Dialect) -> str:
    return f"SELECT probe, id, key, round(cosine, 6) AS cosine FROM ({_best(d)}) AS t"


@sql_over(_searching(apart=True))
def cosine_top1_exclude(d: Dialect) -> str:
    """Whole identities are masked: here the probe's own key."""
    return f"SELECT probe, id, key, round(cosine, 6) AS cosine FROM ({_best(d, 'AND g.key <> p.key')}) AS t"


@sql_over(_searching())
def runner_up(d: Dialect) -> str:
    return f"SELECT probe, key, rival, round(cosine, 6) AS cosine, round(rival_cosine, 6) AS rival_cosine FROM ({_best(d)}) AS t"


@sql_over(_searching(staff=True))
def match_verdict(d: Dialect) -> str:
    """Staff (of all runs) first; else a match at the threshold or above, else a new person."""
    return f"""SELECT probe, CASE WHEN staff >= {d.k.match_threshold} THEN 'staff' WHEN cosine >= {d.k.match_threshold} THEN 'match' ELSE 'mint' END AS verdict,
      CASE WHEN staff >= {d.k.match_threshold} THEN NULL WHEN cosine >= {d.k.match_threshold} THEN key END AS key,
      round(cosine, 6) AS cosine
      FROM ({_best(d, staff=True)}) AS v"""


@sql
def template_counts(d: Dialect) -> str:
    return f"""SELECT key, count(*) AS n, max(quality) AS best, count(CASE WHEN quality < {d.k.canon_width} THEN 1 END) AS sub_canon
      FROM {templates(d)} AS t GROUP BY key"""


@sql
def template_qualities(d: Dialect) -> str:
    """A key's rows by quality, best first, null last, then id."""
    return f"""SELECT key, id, quality, row_number() OVER (PARTITION BY key ORDER BY quality DESC NULLS LAST, id) AS place
      FROM {templates(d)} AS t"""


@sql
def distinct_count(d: Dialect) -> str:
    """Distinct template keys of each run plus the people added by hand."""
    return f"""SELECT t.run_id, t.n + coalesce(m.n, 0) AS people FROM (SELECT run_id, count(DISTINCT key) AS n FROM {templates(d)} AS t0 GROUP BY run_id) AS t
      LEFT JOIN (SELECT run_id, count(*) AS n FROM {manual(d)} AS m0 GROUP BY run_id) AS m ON m.run_id = t.run_id"""


@sql
def gallery_keys(d: Dialect) -> str:
    """The keys of each run: those with templates and, under their own names, those added by hand."""
    hand = f"concat('m', {d.pad('row_number() OVER (PARTITION BY run_id ORDER BY id)', 5)})"
    return f"""SELECT DISTINCT run_id, CAST(key AS {d.text}) AS key, false AS by_hand FROM {templates(d)} AS t
      UNION ALL SELECT run_id, {hand} AS key, true AS by_hand FROM {manual(d)} AS m"""


@sql
def vectors_for(d: Dialect) -> str:
    """A key's rows, oldest first, with their vectors' lengths."""
    return f"""SELECT key, id, {d.size('vec')} AS dim, round(sqrt({d.dot('vec', 'vec')}), 6) AS norm,
      row_number() OVER (PARTITION BY key ORDER BY id) AS place FROM {templates(d)} AS t"""


@sql
def appearances_for(d: Dialect) -> str:
    return f"SELECT key, id, round({d.total('appearance')}, 6) AS mass FROM {templates(d)} AS t WHERE appearance IS NOT NULL"


def _pairs(d: Dialect, on: str, blocks: bool = False, among: View = templates) -> str:
    rows = among(d)
    return f"""SELECT a.key AS key_a, b.key AS key_b, a.id AS id_a, b.id AS id_b, a.quality AS quality_a, b.quality AS quality_b,
      a.appearance AS look_a, b.appearance AS look_b, {d.dot('a.vec', 'b.vec')} AS cosine
      FROM {_asking(d, rows) if blocks else rows} AS a JOIN {_answering(rows) if blocks else rows} AS b
      ON {'a.block = b.block AND ' if blocks else ''}{on}"""


@sql_over(_siblings)
def redundancy_max(d: Dialect) -> str:
    """The closest two rows of each key; null with fewer than two."""
    if "closest" in d.views:
        return f"""SELECT k.key, p.closest FROM (SELECT DISTINCT key FROM {templates(d)} AS t) AS k LEFT JOIN (
      SELECT key, round(max(closest), 6) AS closest FROM {d.views['closest']} AS p0 GROUP BY key) AS p ON p.key = k.key"""
    return f"""SELECT k.key, p.closest FROM (SELECT DISTINCT key FROM {templates(d)} AS t) AS k LEFT JOIN (
      SELECT key_a, round(max(cosine), 6) AS closest FROM ({_pairs(d, 'a.key = b.key AND a.id < b.id')}) AS p0 GROUP BY key_a) AS p
      ON p.key_a = k.key"""


@sql
def prune_to_cap(d: Dialect) -> str:
    return f"""SELECT key, id, quality FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quality DESC NULLS LAST, id) AS place
      FROM {templates(d)} AS t) AS r WHERE place <= {d.k.template_cap}"""


@sql_over(_siblings)
def prune_redundant_step(d: Dialect) -> str:
    """One eviction per key: the row closest to a sibling; ties go by lower quality, then the newer row."""
    near = f"""SELECT key_a AS key, id_a AS id, quality_a AS quality, round(max(cosine), 9) AS closest
        FROM ({_pairs(d, 'a.key = b.key AND a.id <> b.id')}) AS p0 GROUP BY key_a, id_a, quality_a"""
    if "closest" in d.views:
        near = f"SELECT key, id, quality, round(closest, 9) AS closest FROM {d.views['closest']}"
    return f"""SELECT key, id, closest FROM (SELECT key, id, closest,
        row_number() OVER (PARTITION BY key ORDER BY closest DESC, quality ASC NULLS FIRST, id DESC) AS place
      FROM ({near}) AS c) AS r WHERE place = 1"""


@sql_over(_searching(siblings=True))
def enrol_clauses(d: Dialect) -> str:
    """The clauses that let a matched probe be learned, one column each; a probe takes no room of its own key.

    At its cap a key learns only what is further from it than its two closest rows are from each other.
    """
    k = d.k
    crowded = f"""SELECT key_a, round(max(cosine), 9) AS closest FROM ({_pairs(d, "a.key = b.key AND a.id < b.id", among=gallery)}) AS p0 GROUP BY key_a"""
    if "closest" in d.views:
        crowded = f"SELECT key AS key_a, round(max(closest), 9) AS closest FROM {d.views['closest']} AS p0 GROUP BY key"
    return f"""SELECT *, {'true' if k.template_cap > 1 else 'false'} AND confident AND fresh AND clear_of_rival AND (has_room OR beats_redundancy) AS enrols FROM (
      SELECT probe, t.key, cosine >= {k.match_threshold} + {k.enrol_confidence} AS confident, cosine < {k.enrol_max_cosine} AS fresh,
        coalesce(cosine - rival_cosine >= {k.enrol_margin}, true) AS clear_of_rival, c.n - CASE WHEN probe_key = t.key THEN 1 ELSE 0 END < {k.template_cap} AS has_room,
        coalesce(round(cosine, 9) < r.closest, false) AS beats_redundancy
      FROM ({_best(d)}) AS t JOIN (SELECT key, count(*) AS n FROM {gallery(d)} AS g GROUP BY key) AS c ON c.key = t.key
      LEFT JOIN ({crowded}) AS r ON r.key_a = t.key
      WHERE cosine >= {k.match_threshold}) AS e"""


def _with_looks(d: Dialect) -> str:
    """The best clothing overlap with the matched key; null where either side has none."""
    if "alike" in d.views:
        return f"SELECT t.*, l.likeness FROM ({_best(d)}) AS t LEFT JOIN {d.views['alike']} AS l ON l.probe = t.probe"
    return f"""SELECT t.*, l.likeness FROM ({_best(d)}) AS t LEFT JOIN (
      SELECT b.probe, max({d.overlap('p.appearance', 'g.appearance')}) AS likeness
      FROM ({_best(d)}) AS b JOIN {probes(d)} AS p ON p.id = b.probe JOIN {gallery(d)} AS g ON g.key = b.key AND g.id <> p.id
      WHERE p.appearance IS NOT NULL AND g.appearance IS NOT NULL GROUP BY b.probe) AS l
      ON l.probe = t.probe"""


@sql_over(_searching(looks=True))
def best_intersection(d: Dialect) -> str:
    return f"SELECT probe, key, round(likeness, 6) AS likeness FROM ({_with_looks(d)}) AS t"


@sql_over(_searching(looks=True))
def enrol_veto(d: Dialect) -> str:
    """Clashing clothes veto the write, never the verdict; equality is no clash, and neither is absence."""
    return f"""SELECT probe, key, round(likeness, 6) AS likeness, coalesce(likeness < {d.k.clothing_clash}, false) AS vetoed
      FROM ({_with_looks(d)}) AS t WHERE cosine >= {d.k.match_threshold}"""


@sql_over(_searching(looks=True))
def near_miss(d: Dialect) -> str:
    """Mints that nearly matched: by face, or by a weak face and like clothes; not where a pair must stay apart."""
    eps = d.k.band_tolerance
    return f"""SELECT probe, key, basis, round(cosine, 6) AS cosine, round(likeness, 6) AS likeness FROM (
      SELECT t.*, CASE WHEN cosine >= {d.k.near_miss_floor} - {eps} THEN 'face'
        WHEN cosine >= {d.k.near_miss_weak} - {eps} AND likeness >= {d.k.near_miss_clothes} - {eps} THEN 'clothing' END AS basis
      FROM ({_with_looks(d)}) AS t WHERE cosine < {d.k.match_threshold}) AS m
      WHERE basis IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {cannot_link(d)} AS c
        WHERE c.a = least(m.probe_key, m.key) AND c.b = greatest(m.probe_key, m.key))"""


@sql_over(_searching())
def overlap(d: Dialect) -> str:
    """After a write: a rival key that matches as well and isn't kept apart."""
    return f"""SELECT probe, key, rival, round(rival_cosine, 6) AS rival_cosine FROM ({_best(d)}) AS m
      WHERE cosine >= {d.k.match_threshold} AND rival_cosine >= {d.k.match_threshold} AND NOT EXISTS (SELECT 1 FROM {cannot_link(d)} AS c
        WHERE c.a = least(m.key, m.rival) AND c.b = greatest(m.key, m.rival))"""


def review_queue_sql(d: Dialect) -> str:
    """The review queue as one text, for the oracle; :mod:`turnstile.operators.review` runs it in blocks."""
    k = d.k
    order = "CASE WHEN likeness IS NULL THEN 1 ELSE 0 END, round(likeness, 9) DESC, round(cosine, 9) DESC, key_a, key_b"
    return f"""WITH q AS (
      SELECT q0.* FROM (SELECT key_a, key_b, max(cosine) AS cosine,
          max(CASE WHEN look_a IS NOT NULL AND look_b IS NOT NULL THEN {d.overlap('look_a', 'look_b')} END) AS likeness
        FROM ({_pairs(d, 'a.key < b.key', blocks=True)}) AS p0 GROUP BY key_a, key_b
        HAVING max(cosine) >= {k.review_floor} AND max(cosine) < {k.match_threshold}) AS q0
      WHERE NOT EXISTS (SELECT 1 FROM {cannot_link(d)} AS c WHERE c.a = q0.key_a AND c.b = q0.key_b))
      SELECT key_a, key_b, round(cosine, 6) AS cosine, round(likeness, 6) AS likeness, row_number() OVER (ORDER BY {order}) AS place, considered,
        considered - least(considered, {k.review_limit}) AS dropped
      FROM (SELECT * FROM q ORDER BY {order} LIMIT {k.review_limit}) AS r CROSS JOIN (SELECT count(*) AS considered FROM q) AS n"""


def _look_pairs(spark: SparkSession, d: Dialect) -> dict[str, DataFrame]:
    return {"look_pairs": look_pairs(spark.sql(f"SELECT * FROM {templates(d)} AS v0"))}


@sql_over(_look_pairs)
def hist_intersection(d: Dialect) -> str:
    """The clothing overlap of each two rows of a key."""
    if "look_pairs" in d.views:
        return f"SELECT id_a, id_b, likeness FROM {d.views['look_pairs']}"
    like = d.fail_unless(f"{d.size('a.appearance')} = {d.size('b.appearance')}", "histograms differ in length", f"round({d.overlap('a.appearance', 'b.appearance')}, 6)")
    return f"""SELECT a.id AS id_a, b.id AS id_b, {like} AS likeness
      FROM {templates(d)} AS a JOIN {templates(d)} AS b ON a.key = b.key AND a.id < b.id
      WHERE a.appearance IS NOT NULL AND b.appearance IS NOT NULL"""


@sql
def unit_vectors(d: Dialect) -> str:
    """Vectors scaled to length one; a zero vector or one of under eight numbers is an error."""
    scaled = d.total(d.each("vec", "x", f"x / sqrt({d.dot('vec', 'vec')})"))
    total = d.fail_unless(f"{d.size('vec')} >= 8 AND {d.dot('vec', 'vec')} > 0", "a vector needs eight numbers and a length", f"round({scaled}, 6)")
    return f"SELECT id, round({d.dot('vec', 'vec')}, 6) AS squared, {total} AS unit_sum FROM {templates(d)} AS t"


@sql
def sub_canon_tag(d: Dialect) -> str:
    return f"SELECT id, key, coalesce(quality < {d.k.canon_width}, false) AS sub_canon FROM {templates(d)} AS t"
