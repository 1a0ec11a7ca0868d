"""Identity reconciliation: candidates, corrections and their ledgers.

Corrections are new snapshots, never updates in place: each operator gives the
rows after it. The order-dependent part is in :mod:`turnstile.operators.folds`.
"""

from __future__ import annotations

from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import sql
from turnstile.sources.bindings import acts, cannot_link, feedback, ledger, marks, stores, templates, tombstones, verdicts


def _us(seconds: float) -> int:
    return int(seconds * 1_000_000)


@sql
def same_frame_conflicts(d: Dialect) -> str:
    """One key twice in a frame: the mint, else the highest cosine, keeps it; others lose it if
    their body is another and their clothes clash; what is unknown never splits."""
    return f"""SELECT l.frame, l.key, k.n AS keeper, l.n AS loser FROM (
        SELECT *, row_number() OVER (PARTITION BY frame, key ORDER BY CASE WHEN minted THEN 0 ELSE 1 END, cosine DESC, n) AS rn FROM {verdicts(d)} AS v) AS k
      JOIN {verdicts(d)} AS l ON l.frame = k.frame AND l.key = k.key AND l.n <> k.n
      WHERE k.rn = 1 AND l.body <> k.body AND 1 - abs(l.look - k.look) < {d.k.same_frame_clothing}"""


@sql
def forget_template(d: Dialect) -> str:
    """Rows asked to be forgotten go, but never the last of a key."""
    return f"""SELECT id, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN forget THEN 1 ELSE 0 END, id) AS rn
      FROM {templates(d)} AS t) AS r WHERE NOT forget OR rn = 1"""


def _bodies(d: Dialect, rows: str, frame: str) -> str:
    """Pairs of keys of a frame, smaller first, and whether they were on different bodies.

    Each key has a set of bodies; a face without one is on another body than anyone, and
    keys that share a body in the frame are one body with two faces.
    """
    own = f"(SELECT DISTINCT {frame}, key, body FROM {rows} AS v0)"
    met = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in frame.split(","))
    by = ", ".join(f"a.{c.strip()}" for c in frame.split(","))
    return f"""SELECT {by}, a.key AS key_a, b.key AS key_b,
      max(CASE WHEN a.body IS NULL OR b.body IS NULL THEN 1 ELSE 0 END) = 1 OR max(CASE WHEN a.body = b.body THEN 1 ELSE 0 END) = 0 AS differ
      FROM {own} AS a JOIN {own} AS b ON {met} AND a.key < b.key GROUP BY {by}, a.key, b.key"""


@sql
def different_bodies(d: Dialect) -> str:
    """Two keys of a frame are different bodies if their box sets are disjoint; a face in no box is on another body than anyone."""
    return _bodies(d, verdicts(d), "frame")


@sql
def co_presence(d: Dialect) -> str:
    """Pairs of people seen on different bodies of one frame, without staff: the first such frame of each pair, capped per run."""
    guests = f"(SELECT * FROM {verdicts(d)} AS g0 WHERE NOT staff)"
    return f"""SELECT run_id, key_a, key_b, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, key_a, key_b) AS rn FROM (
      SELECT run_id, key_a, key_b, min(frame) AS seq FROM ({_bodies(d, guests, 'run_id, frame')}) AS b WHERE differ GROUP BY run_id, key_a, key_b) AS p) AS r
      WHERE rn <= {d.k.co_presence_cap}"""


def _bucket(d: Dialect, seconds: float) -> str:
    """Buckets of time as long as a window, so that what a window holds lies in two of them."""
    return d.whole(f"us / {_us(seconds)}.0E0")


@sql
def heal_candidates(d: Dialect) -> str:
    """Mints that a strong match on the same track, soon after and of another key, may fold in: not
    where the frame of the match shows both keys on different bodies, nor where clothes clash.

    Mints stand in their own bucket of time and the next, so a track's life is cut into joins of a window's size.
    """
    b = _bucket(d, d.k.heal_seconds)
    mints = f"""(SELECT track, event_id, us, key, look, {b} AS bucket FROM {acts(d)} AS a1 WHERE minted
      UNION ALL SELECT track, event_id, us, key, look, {b} + 1 AS bucket FROM {acts(d)} AS a2 WHERE minted)"""
    heals = f"(SELECT run_id, track, event_id, us, key, look, {b} AS bucket FROM {acts(d)} AS a3 WHERE NOT minted AND cosine >= {d.k.heal_cosine})"
    return f"""SELECT c.track, c.mint, c.heal, c.fold, c.keep FROM (
        SELECT m.track, m.event_id AS mint, x.event_id AS heal, m.key AS fold, x.key AS keep, x.run_id, x.us FROM {mints} AS m JOIN {heals} AS x
        ON m.track = x.track AND m.bucket = x.bucket AND x.us > m.us AND x.us <= m.us + {_us(d.k.heal_seconds)}
        WHERE x.key <> m.key AND coalesce(1 - abs(m.look - x.look) >= {d.k.clothing_refuse}, true)) AS c
      LEFT JOIN (SELECT * FROM ({_bodies(d, acts(d), 'run_id, us')}) AS d0 WHERE differ) AS d1
      ON d1.run_id = c.run_id AND d1.us = c.us AND d1.key_a = least(c.fold, c.keep) AND d1.key_b = greatest(c.fold, c.keep) WHERE d1.key_a IS NULL"""


def _locked(d: Dialect) -> str:
    """Each mint with the strong match that its track was locked to: the last one before, while that is fresh."""
    if d.spark:
        # The last strong match lies in the mint's bucket or the one before; a bucket is all that meets in one task.
        b = _bucket(d, d.k.lock_seconds)
        strong = f"CASE WHEN NOT minted AND cosine >= {d.k.lock_cosine} THEN struct(us AS lock_us, event_id AS lock_event, key AS lock_key, look AS lock_look) END"
        rows = f"SELECT *, {b} AS bucket, {strong} AS strong FROM {acts(d)} AS a"
        near = f"""SELECT *, max(strong) OVER (PARTITION BY track, bucket ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ({rows}) AS r"""
        last = f"SELECT track, bucket + 1 AS bucket, max(strong) AS strong FROM ({rows}) AS r1 WHERE strong IS NOT NULL GROUP BY track, bucket"
        held = f"""SELECT n.*, coalesce(n.held, l.strong) AS lock FROM (SELECT * FROM ({near}) AS n0 WHERE minted) AS n LEFT JOIN ({last}) AS l ON l.track = n.track AND l.bucket = n.bucket"""
        return f"""SELECT run_id, track, event_id, us, key, clash, look, CASE WHEN us - lock.lock_us <= {_us(d.k.lock_seconds)} THEN lock.lock_key END AS locked,
          lock.lock_us AS lock_us, lock.lock_look AS lock_look FROM ({held}) AS h"""
    return f"""SELECT m.run_id, m.track, m.event_id, m.us, m.key, m.clash, m.look, CASE WHEN m.us - x.us <= {_us(d.k.lock_seconds)} THEN x.key END AS locked, x.us AS lock_us, x.look AS lock_look
      FROM (SELECT * FROM {acts(d)} AS a WHERE minted) AS m ASOF LEFT JOIN
        (SELECT track, us, max(event_id) AS event_id, arg_max(key, event_id) AS key, arg_max(look, event_id) AS look FROM {acts(d)} AS b WHERE NOT minted AND cosine >= {d.k.lock_cosine} GROUP BY track, us) AS x
      ON m.track = x.track AND m.us > x.us"""


@sql
def lock_asof(d: Dialect) -> str:
    """The key a track is locked to at each mint: its last strong match, while that is fresh."""
    return f"SELECT track, event_id, locked FROM ({_locked(d)}) AS l0"


@sql
def lock_folds(d: Dialect) -> str:
    """Mints on a locked track that fold into the lock's key: another key, not on another body of the frame.

    A mint whose clothes clash with the lock's isn't folded and drops the lock, for all later mints under it.
    """
    tried = f"""SELECT l.*, clash AND d1.key_a IS NULL AS drops, d1.key_a IS NOT NULL AS elsewhere FROM (SELECT * FROM ({_locked(d)}) AS l0 WHERE locked IS NOT NULL AND locked <> key) AS l
      LEFT JOIN (SELECT * FROM ({_bodies(d, acts(d), 'run_id, us')}) AS d0 WHERE differ) AS d1
      ON d1.run_id = l.run_id AND d1.us = l.us AND d1.key_a = least(l.key, l.locked) AND d1.key_b = greatest(l.key, l.locked)"""
    return f"""SELECT track, event_id, locked FROM (SELECT *, coalesce(max(CASE WHEN drops THEN 1 ELSE 0 END) OVER (
        PARTITION BY track, lock_us ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dropped FROM ({tried}) AS t) AS t1
      WHERE NOT elsewhere AND NOT drops AND dropped = 0"""


@sql
def clothing_bands(d: Dialect) -> str:
    """Likeness under the lower bar refuses, under the upper one goes on and is counted, unknown is neither."""
    return f"""SELECT frame, n, look, CASE WHEN look < {d.k.clothing_refuse} THEN 'refuse' WHEN look < {d.k.clothing_uncertain} THEN 'uncertain' WHEN look IS NOT NULL THEN 'fine' END AS band
      FROM {verdicts(d)} AS v"""


@sql
def recent_mints(d: Dialect) -> str:
    """The last few mints of each track that are still fresh at its last sighting."""
    return f"""SELECT track, event_id, key FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY us DESC, event_id DESC) AS rn,
      max(us) OVER (PARTITION BY track) AS now FROM {acts(d)} AS a WHERE minted) AS r WHERE rn <= {d.k.recent_mints} AND now - us <= {_us(d.k.heal_seconds)}"""


@sql
def merge_only_singletons(d: Dialect) -> str:
    """Keys that a merge limited to singletons may fold: one template only."""
    return f"SELECT key, count(*) AS n, count(*) = 1 AS foldable FROM {templates(d)} AS t GROUP BY key"


@sql
def split_record(d: Dialect) -> str:
    """New constraints from feedback join the old ones; a pair with itself is invalid."""
    return f"""SELECT DISTINCT a, b FROM (SELECT a, b FROM {cannot_link(d)} AS c
      UNION ALL SELECT least(a, b), greatest(a, b) FROM {feedback(d)} AS f WHERE kind = 'false-match' AND a <> b) AS u"""


@sql
def mark_staff(d: Dialect) -> str:
    """Templates of marked people move to the staff store, without clothes, under a new name where unnamed."""
    return f"""SELECT t.id, t.key, CASE WHEN m.key IS NOT NULL THEN coalesce(m.name, concat('anon', {d.pad('t.key', 5)})) END AS staff_id,
      CASE WHEN m.key IS NOT NULL THEN 'staff' ELSE 'guest' END AS store, t.appearance IS NOT NULL AND m.key IS NULL AS has_clothes
      FROM {templates(d)} AS t LEFT JOIN {marks(d)} AS m ON m.key = t.key"""


@sql
def staff_enrol(d: Dialect) -> str:
    """A member's enrolment replaces all earlier templates of the member."""
    return f"""SELECT key, id FROM (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY enrolment DESC) AS age FROM {templates(d)} AS t) AS r WHERE age = 1"""


@sql
def staff_purge(d: Dialect) -> str:
    """Erasure by tombstone: how many templates each id lost; ids without any are answered too."""
    return f"""SELECT s.key, count(t.id) AS removed FROM {tombstones(d)} AS s
      LEFT JOIN {templates(d)} AS t ON t.key = s.key GROUP BY s.key"""


@sql
def manual_add(d: Dialect) -> str:
    """People added by hand: counted per run, named m#####, without a vector."""
    return f"""SELECT run_id, concat('m', {d.pad('row_number() OVER (PARTITION BY run_id ORDER BY conv_id, turn)', 5)}) AS key, conv_id, turn
      FROM {feedback(d)} AS f WHERE kind = 'missed'"""


@sql
def mint_keys(d: Dialect) -> str:
    """Keys per run in the order of mints: one sequence a gallery, never reused."""
    return f"""SELECT run_id, track, event_id, concat('p', {d.pad('row_number() OVER (PARTITION BY run_id ORDER BY us, event_id)', 5)}) AS key FROM {acts(d)} AS a WHERE minted"""


@sql
def retired_ledger(d: Dialect) -> str:
    """The last folded keys of each run."""
    return f"""SELECT run_id, event_id, key FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY us DESC, event_id DESC) AS rn
      FROM {acts(d)} AS a WHERE NOT minted AND folded) AS r WHERE rn <= {d.k.retired_rows}"""


@sql
def retention_sweep(d: Dialect) -> str:
    """Galleries untouched for the retention are dropped; staff stores never."""
    return f"SELECT run_id, last_us, NOT staff AND last_us <= now_us - {_us(d.k.retention_seconds)} AS dropped FROM {stores(d)} AS s"


@sql
def feedback_plan(d: Dialect) -> str:
    """Feedback items as actions; a pair needs two different keys."""
    pair = "a IS NOT NULL AND b IS NOT NULL AND a <> b"
    return f"""SELECT conv_id, turn, CASE WHEN kind = 'duplicate' AND {pair} THEN 'merge' WHEN kind = 'false-match' AND {pair} THEN 'split'
      WHEN kind = 'mark-staff' AND a IS NOT NULL AND has_store THEN 'mark-staff' WHEN kind = 'missed' THEN 'count-missed' WHEN kind = 'note' THEN 'ack' ELSE 'invalid' END AS action,
      CASE WHEN kind IN ('duplicate', 'false-match') AND {pair} THEN concat(CAST(a AS {d.text}), '|', CAST(b AS {d.text})) END AS keys FROM {feedback(d)} AS f"""


@sql
def feedback_apply(d: Dialect) -> str:
    """Each item takes effect once: settled ones are only reported again, open ones are tried again, new ones are taken."""
    return f"""SELECT f.conv_id, f.turn, f.kind, l.conv_id IS NOT NULL AS seen_before,
      CASE WHEN l.settled THEN 'settled' WHEN l.conv_id IS NOT NULL THEN 'open' ELSE 'new' END AS state, coalesce(NOT l.settled, true) AS applies
      FROM {feedback(d)} AS f LEFT JOIN {ledger(d)} AS l ON l.conv_id = f.conv_id AND l.turn = f.turn"""
