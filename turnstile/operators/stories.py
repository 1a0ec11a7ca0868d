"""Identity reconciliation of whole runs: the order-dependent part, in batch and as a stream.

A frame: match every face; split one key on two bodies; note who stands apart; then
per face fold a mint into its track's lock, or record it, or let a strong match heal
earlier mints of its track. The same :class:`Story` runs in both: in batch its state
is handed from batch to batch of a run's rows, in the stream it is kept in Spark's
state store, one entry a template, lock, mint and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnstile.operators.folds import DIGITS, Gallery, Template, fold_in_order, templates_of
from turnstile.plans.dialect import DUCKDB
from turnstile.plans.registry import frames
from turnstile.settings import DEFAULTS, FIXTURE, Settings
from turnstile.sources import bindings

STORY_DDL = "run_id long, frame long, n long, id long, key long, people long, merged long, healed long, split long, vetoed long, uncertain long"

#: The counts of a story, in the order of its output.
COUNTS = ("people", "merged", "healed", "split", "vetoed", "uncertain")


@dataclass
class Face:
    """A face of a frame: the track and the person box that hold it (None: none does), what was seen."""

    template: Template
    track: int | None = None
    body: int | None = None
    staff: bool = False


@dataclass
class Mint:
    key: int
    look: np.ndarray | None
    at: int


def different_bodies(bodies: dict[int, set[int | None]], a: int, b: int) -> bool:
    """Whether a frame shows two keys on two bodies; a face without a box is on another body than anyone."""
    one, other = bodies.get(a), bodies.get(b)
    if not one or not other:
        return False
    return None in one or None in other or one.isdisjoint(other)


@dataclass
class Story:
    """Gallery, tracks, locks and mints of one run: their order is their meaning."""

    settings: Settings = DEFAULTS
    gallery: Gallery = None  # type: ignore[assignment]
    asserted: set[tuple[int, int]] = field(default_factory=set)
    mints: dict[int, list[Mint]] = field(default_factory=dict)
    locks: dict[int, Mint] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))

    def __post_init__(self) -> None:
        self.gallery = self.gallery or Gallery(self.settings)

    def frame(self, t_ms: int, faces: list[Face]) -> list[int | None]:
        """The key of each face of a frame, None for staff, who are no guests."""
        guests = [i for i, f in enumerate(faces) if not f.staff]
        found = {i: self.gallery.match(faces[i].template) for i in guests}
        self._split_shared_keys(faces, found)
        bodies: dict[int, set[int | None]] = {}
        for i in guests:
            bodies.setdefault(found[i]["key"], set()).add(faces[i].body)
        self._hold_apart(bodies)
        for i in guests:
            face, verdict = faces[i], found[i]
            self.counts["people"] += verdict["is_new"]
            if face.track is None:
                continue
            if not verdict["is_new"]:
                self._heal(t_ms, face, verdict, bodies)
                if verdict["cosine"] >= self.settings.lock_cosine:
                    self.locks[face.track] = Mint(verdict["key"], face.template.look, t_ms)
            elif not self._fold_into_lock(t_ms, face, verdict, bodies):
                mint = Mint(verdict["key"], face.template.look, t_ms)
                self.mints[face.track] = [*self.mints.get(face.track, []), mint][-self.settings.recent_mints :]
        return [found[i]["key"] if i in found else None for i in range(len(faces))]

    def _split_shared_keys(self, faces: list[Face], found: dict[int, dict]) -> None:
        """One key on two bodies in clashing clothes: a mint keeps it, else the highest cosine; others are matched again without it."""
        sharing: dict[int, list[int]] = {}
        for i, v in found.items():
            sharing.setdefault(v["key"], []).append(i)
        for key, own in sharing.items():
            keeper, *others = sorted(own, key=lambda i: (not found[i]["is_new"], -(-1.0 if found[i]["cosine"] is None else found[i]["cosine"])))
            for i in others:
                one, other = faces[keeper], faces[i]
                if one.body is None or other.body is None or one.body == other.body:
                    continue
                like = likeness(one.template.look, other.template.look)
                if like is None or like >= self.settings.same_frame_clothing:
                    continue
                self.counts["split"] += 1
                rows = self.gallery.people[key]
                if found[i]["added"] and len(rows) > 1:  # what the wrong match learnt is forgotten, but never a key's last template
                    self.gallery.people[key] = [r for r in rows if r.id != other.template.id]
                found[i] = self.gallery.match(other.template, [key])

    def _hold_apart(self, bodies: dict[int, set[int | None]]) -> None:
        """Keys on different bodies of a frame are different people for good, up to a number of pairs a run."""
        keys = sorted(bodies)
        for n, a in enumerate(keys):
            for b in keys[n + 1 :]:
                if (a, b) not in self.asserted and len(self.asserted) < self.settings.co_presence_cap and different_bodies(bodies, a, b):
                    self.asserted.add((a, b))
                    self.gallery.apart.add((a, b))

    def _clash(self, before: np.ndarray | None, now: np.ndarray | None) -> bool:
        like = likeness(before, now)
        if like is None:
            return False
        if like < self.settings.clothing_refuse:
            self.counts["vetoed"] += 1
            return True
        self.counts["uncertain"] += like < self.settings.clothing_uncertain
        return False

    def _fold(self, keep: int, drop: int) -> bool:
        """A mint that is still a single template goes into ``keep``, if they needn't stay apart."""
        if len(self.gallery.people.get(drop, ())) != 1 or not self.gallery.merge(keep, drop):
            return False
        self.counts["people"] = max(0, self.counts["people"] - 1)
        return True

    def _fold_into_lock(self, t_ms: int, face: Face, verdict: dict, bodies: dict) -> bool:
        self.locks = {t: e for t, e in self.locks.items() if t_ms - e.at <= self.settings.lock_seconds * 1000}
        lock, key = self.locks.get(face.track), verdict["key"]
        if lock is None or different_bodies(bodies, key, lock.key) or lock.key == key:
            return False
        if self._clash(lock.look, face.template.look):
            del self.locks[face.track]  # the track is on someone else by now
            return False
        if not self._fold(lock.key, key):
            return False
        self.counts["merged"] += 1
        verdict["key"] = lock.key
        return True

    def _heal(self, t_ms: int, face: Face, verdict: dict, bodies: dict) -> None:
        """A strong match disowns the other fresh mints of its track; each is tried once, merged or refused."""
        key = verdict["key"]
        if verdict["cosine"] < self.settings.heal_cosine:
            return
        live = [m for m in self.mints.pop(face.track, []) if t_ms - m.at <= self.settings.heal_seconds * 1000]
        kept = [m for m in live if m.key == key]
        if kept:
            self.mints[face.track] = kept
        for mint in live:
            if mint.key == key or different_bodies(bodies, mint.key, key) or self._clash(mint.look, face.template.look):
                continue
            if self._fold(key, mint.key):
                self.counts["healed"] += 1


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """Overlap of two clothing histograms; unknown where one is."""
    return None if a is None or b is None else float(np.minimum(a, b).sum())


def _number(x: Any) -> int | None:
    return None if x is None or x != x else int(x)


def tell(run_id: int, rows: pd.DataFrame, story: Story) -> list[tuple]:
    """Whole frames of a run through its story; a row a face, with the counts after its frame."""
    out = []
    for frame, own in rows.groupby("frame", sort=True):
        own = own.sort_values("n")
        faces = [
            Face(t, _number(track), _number(body), bool(staff))
            for t, track, body, staff in zip(templates_of(own), own["track"], own["body"], own["staff"], strict=True)
        ]
        keys = story.frame(int(own["t_ms"].iloc[0]), faces)
        counts = tuple(story.counts[c] for c in COUNTS)
        out += [(int(run_id), int(frame), int(n), f.template.id, key, *counts) for n, f, key in zip(own["n"], faces, keys, strict=True)]
    return out


READ = ["run_id", "frame", "t_ms", "n", "track", "body", "staff", "id", "vec", "quality", "appearance"]


def story_sql() -> str:
    """The stories as a recursive query, one small step a row: the oracle.

    A frame's program is: M, match a face; S, settle one face that shares a key; B, hold bodies apart; then for
    each face F, what its track remembers, H, heal one mint, and L, the lock; and O, what is told.
    """
    k, d = FIXTURE, DUCKDB
    cosine = lambda a, b: f"round(list_sum(list_transform(list_zip({a}, {b}), lambda zz: zz[1] * zz[2])), {DIGITS})"
    of_key = lambda rows, key: f"list_filter({rows}, lambda p: p.key = {key})"
    differ = lambda a, b: (
        f"(len(list_filter(bodies, lambda u: u.key = {a})) > 0 AND len(list_filter(bodies, lambda u: u.key = {b})) > 0 AND (len(list_filter(bodies, lambda u: u.key IN ({a}, {b}) AND u.body IS NULL)) > 0 "
        f"OR len(list_intersect(list_transform(list_filter(bodies, lambda u: u.key = {a}), lambda u: u.body), list_transform(list_filter(bodies, lambda u: u.key = {b}), lambda u: u.body))) = 0))"
    )
    near = f"list_max(list_transform(list_filter(grown, lambda v: v.id <> r.id), lambda v: {cosine('v.vec', 'r.vec')}))"
    goes = f"-list_sort(list_transform(grown, lambda r: struct_pack(near := -{near}, quality := coalesce(r.quality, '-inf'::DOUBLE), id := -r.id)))[1].id"
    crowded = f"list_max(flatten(list_transform(own, lambda r: list_transform(list_filter(own, lambda v: v.id <> r.id), lambda v: {cosine('v.vec', 'r.vec')}))))"
    row = "struct_pack(key := {key}, id := y.id, vec := y.vec, quality := y.quality, look := y.look)"
    template = "STRUCT(key BIGINT, id BIGINT, vec DOUBLE[], quality DOUBLE, look DOUBLE[])"
    face = "STRUCT(n BIGINT, id BIGINT, vec DOUBLE[], quality DOUBLE, look DOUBLE[], track BIGINT, body BIGINT, key BIGINT, is_new BOOLEAN, cos DOUBLE, added BOOLEAN)"
    memory = "STRUCT(track BIGINT, key BIGINT, look DOUBLE[], since BIGINT)"
    pair = "STRUCT(a BIGINT, b BIGINT)"
    seen = "struct_pack(n := y.n, id := y.id, vec := y.vec, quality := y.quality, look := y.look, track := y.track, body := y.body, key := {key}, is_new := is_new, cos := cos, added := {added})"
    carried = "run_id, k, op, slot, frame, t"
    state = "people, minted, apart, asserted, bodies, mints, locks, found, tasks, doomed, n_people, merged, healed, split, vetoed, uncertain"
    fresh = f"struct_pack(track := e.track, key := e.key, look := e.look, since := t)"
    ranked = "list_sort(list_transform(list_filter(range(1, len(found) + 1), lambda j: found[j].key = found[i].key), lambda j: struct_pack(m := NOT found[j].is_new, c := -coalesce(found[j].cos, -1.0), j := j)))"
    shared = f"""flatten(list_transform(list_filter(range(1, len(found) + 1), lambda i: len(list_filter(found[1:i - 1], lambda u: u.key = found[i].key)) = 0),
        lambda i: list_transform([{ranked}], lambda o: list_transform(o[2:], lambda z: struct_pack(i := z.j, keeper := o[1].j)))[1]))"""
    together = f"""list_transform(flatten(list_transform(range(1, len(keys) + 1), lambda i: list_transform(range(i + 1, len(keys) + 1), lambda j: struct_pack(a := keys[i], b := keys[j])))), lambda z: z)"""
    return f"""WITH RECURSIVE face AS (
      SELECT run_id, frame, t_ms AS t, n, row_number() OVER (PARTITION BY run_id, frame ORDER BY n) AS q, count(*) OVER (PARTITION BY run_id, frame) AS many,
        struct_pack(n := n, id := id, vec := vec, quality := quality, look := appearance, track := CAST(track AS BIGINT), body := CAST(body AS BIGINT)) AS x
      FROM {bindings.encounters(d)} AS e0 WHERE NOT staff),
    framed AS (SELECT run_id, frame, min(t_ms) AS t FROM {bindings.encounters(d)} AS e1 GROUP BY run_id, frame),
    code AS (
      SELECT run_id, frame, t, 0 AS phase, q, 0 AS part, 'M' AS op, q AS slot, x FROM face
      UNION ALL SELECT run_id, frame, t, 1, q, 0, 'S', q, x FROM face
      UNION ALL SELECT run_id, frame, t, 2, 0, 0, 'B', 0, NULL FROM framed
      UNION ALL SELECT run_id, frame, t, 3, q, 0, 'F', q, x FROM face
      UNION ALL SELECT run_id, frame, t, 3, q, h, 'H', h, x FROM face, range(1, {k.recent_mints + 1}) AS u(h)
      UNION ALL SELECT run_id, frame, t, 3, q, {k.recent_mints + 1}, 'L', q, x FROM face
      UNION ALL SELECT run_id, frame, t, 4, 0, 0, 'O', 0, NULL FROM framed),
    program AS (SELECT run_id, frame, t, op, slot, x, q, row_number() OVER (PARTITION BY run_id ORDER BY frame, phase, q, part) AS k FROM code),
    step AS (
      SELECT run_id, 0::BIGINT AS k, '' AS op, 0::BIGINT AS frame, []::{template}[] AS people, 0::BIGINT AS minted, []::{pair}[] AS apart, []::{pair}[] AS asserted,
        []::STRUCT(key BIGINT, body BIGINT)[] AS bodies, []::{memory}[] AS mints, []::{memory}[] AS locks, []::{face}[] AS found, []::STRUCT(i BIGINT, keeper BIGINT)[] AS tasks, []::{memory}[] AS doomed,
        0::BIGINT AS n_people, 0::BIGINT AS merged, 0::BIGINT AS healed, 0::BIGINT AS split, 0::BIGINT AS vetoed, 0::BIGINT AS uncertain
      FROM (SELECT DISTINCT run_id FROM framed) AS r0
      UNION ALL
      -- 6: merges of H and L, and what follows from them.
      SELECT run_id, k, op, frame,
        CASE WHEN folds THEN list_concat(list_filter(people, lambda p: p.key NOT IN (keep, gone)), CASE WHEN len(grown) <= {k.template_cap} THEN grown ELSE list_filter(grown, lambda r: r.id <> goes) END) ELSE people END AS people,
        minted, CASE WHEN folds THEN list_distinct(list_filter(list_transform(apart, lambda p: struct_pack(a := least(CASE WHEN p.a = gone THEN keep ELSE p.a END, CASE WHEN p.b = gone THEN keep ELSE p.b END),
            b := greatest(CASE WHEN p.a = gone THEN keep ELSE p.a END, CASE WHEN p.b = gone THEN keep ELSE p.b END))), lambda p: p.a <> p.b)) ELSE apart END AS apart,
        asserted, bodies,
        CASE WHEN op = 'L' AND e.track IS NOT NULL AND e.is_new AND NOT folds THEN list_concat(list_filter(mints, lambda m: m.track <> e.track),
          list_transform([list_append(list_filter(mints, lambda m: m.track = e.track), {fresh})], lambda o: o[greatest(1, len(o) - {k.recent_mints - 1}):])[1]) ELSE mints END AS mints,
        CASE WHEN op = 'L' AND e.track IS NOT NULL AND NOT e.is_new AND e.cos >= {k.lock_cosine} THEN list_append(list_filter(locks, lambda m: m.track <> e.track), {fresh})
          WHEN op = 'L' AND clash THEN list_filter(locks, lambda m: m.track <> e.track) ELSE locks END AS locks,
        CASE WHEN op = 'L' AND folds THEN list_transform(range(1, len(found) + 1), lambda i: CASE WHEN i = slot THEN struct_pack(n := found[i].n, id := found[i].id, vec := found[i].vec, quality := found[i].quality,
          look := found[i].look, track := found[i].track, body := found[i].body, key := keep, is_new := found[i].is_new, cos := found[i].cos, added := found[i].added) ELSE found[i] END) ELSE found END AS found,
        tasks, doomed, CASE WHEN folds THEN greatest(0, n_people - 1) ELSE n_people END AS n_people, merged + CASE WHEN folds AND op = 'L' THEN 1 ELSE 0 END AS merged,
        healed + CASE WHEN folds AND op = 'H' THEN 1 ELSE 0 END AS healed, split, vetoed + CASE WHEN clash THEN 1 ELSE 0 END AS vetoed, uncertain + CASE WHEN unsure THEN 1 ELSE 0 END AS uncertain
      FROM (SELECT *, {goes} AS goes FROM (SELECT *, CASE WHEN folds THEN list_concat(list_filter(people, lambda p: p.key = keep), list_transform(list_filter(people, lambda p: p.key = gone),
            lambda p: struct_pack(key := keep, id := p.id, vec := p.vec, quality := p.quality, look := p.look))) ELSE []::{template}[] END AS grown
        FROM (SELECT *, tries AND NOT clash AND len({of_key('people', 'gone')}) = 1 AND keep <> gone AND len({of_key('people', 'keep')}) > 0
              AND len(list_filter(apart, lambda p: p.a = least(keep, gone) AND p.b = greatest(keep, gone))) = 0 AS folds
          FROM (SELECT *, coalesce(tries AND alike < {k.clothing_refuse}, false) AS clash, coalesce(tries AND alike >= {k.clothing_refuse} AND alike < {k.clothing_uncertain}, false) AS unsure
            FROM (SELECT *, CASE WHEN tries AND before IS NOT NULL AND e.look IS NOT NULL THEN {d.overlap('before', 'e.look')} END AS alike
              -- 5: what H and L try to fold: a doomed mint into the match, a mint into the lock.
              FROM (SELECT * EXCLUDE (held), CASE op WHEN 'H' THEN doomed[slot].key WHEN 'L' THEN e.key END AS gone, CASE op WHEN 'H' THEN e.key WHEN 'L' THEN held.key END AS keep,
                  CASE op WHEN 'H' THEN doomed[slot].look WHEN 'L' THEN held.look END AS before,
                  coalesce(CASE op WHEN 'H' THEN slot <= len(doomed) WHEN 'L' THEN e.track IS NOT NULL AND e.is_new AND held.key IS NOT NULL AND held.key <> e.key AND NOT {differ('e.key', 'held.key')} END, false) AS tries
                FROM (SELECT * EXCLUDE (locks0), locks0 AS locks, CASE WHEN op = 'L' THEN list_filter(locks0, lambda m: m.track = e.track)[1] END AS held
                  -- 4: B and F.
                  FROM (SELECT {carried}, people, minted, e, tasks, found, split, merged, healed, vetoed, uncertain,
                      CASE WHEN op = 'L' AND e.track IS NOT NULL AND e.is_new THEN list_filter(locks, lambda m: t - m.since <= {k.lock_seconds * 1000}) ELSE locks END AS locks0,
                      CASE WHEN op = 'B' THEN list_distinct(list_concat(apart, news)) ELSE apart END AS apart, CASE WHEN op = 'B' THEN list_concat(asserted, news) ELSE asserted END AS asserted, bodies,
                      n_people + CASE WHEN op = 'F' AND e.is_new THEN 1 ELSE 0 END AS n_people,
                      CASE WHEN op = 'F' AND heals THEN list_concat(list_filter(mints, lambda m: m.track <> e.track), list_filter(live, lambda m: m.key = e.key)) ELSE mints END AS mints,
                      CASE WHEN op = 'F' THEN CASE WHEN heals THEN list_filter(live, lambda m: m.key <> e.key AND NOT {differ('m.key', 'e.key')}) ELSE []::{memory}[] END ELSE doomed END AS doomed
                    FROM (SELECT *, CASE WHEN op = 'F' THEN coalesce(e.track IS NOT NULL AND NOT e.is_new AND e.cos >= {k.heal_cosine}, false) ELSE false END AS heals,
                        CASE WHEN op = 'F' THEN list_filter(mints, lambda m: m.track = e.track AND t - m.since <= {k.heal_seconds * 1000}) ELSE []::{memory}[] END AS live,
                        CASE WHEN op = 'B' THEN list_filter({together}, lambda z: len(list_filter(asserted, lambda p: p.a = z.a AND p.b = z.b)) = 0 AND {differ('z.a', 'z.b')})[1:greatest(0, {k.co_presence_cap} - len(asserted))] ELSE []::{pair}[] END AS news
                      FROM (SELECT *, CASE WHEN op IN ('F', 'L') THEN found[slot] WHEN op = 'H' THEN found[q] END AS e,
                          CASE WHEN op = 'B' THEN list_sort(list_distinct(list_transform(found, lambda u: u.key))) ELSE []::BIGINT[] END AS keys
                        FROM (SELECT * EXCLUDE (bodies), CASE WHEN op = 'B' THEN list_transform(found, lambda u: struct_pack(key := u.key, body := u.body)) ELSE bodies END AS bodies
                          -- 3: the gallery learns what M or S matched.
                          FROM (SELECT {carried}, q, apart, asserted, bodies, mints, locks, tasks, doomed, n_people, merged, healed, vetoed, uncertain, split + CASE WHEN op = 'S' AND acts THEN 1 ELSE 0 END AS split,
                              minted + CASE WHEN acts AND is_new THEN 1 ELSE 0 END AS minted,
                              CASE WHEN NOT acts THEN people WHEN is_new THEN list_append(people, {row.format(key='minted + 1')}) WHEN enrols THEN list_concat(list_filter(people, lambda p: p.key <> key),
                                CASE WHEN len(grown) <= {k.template_cap} THEN grown ELSE list_filter(grown, lambda r: r.id <> goes) END) ELSE people END AS people,
                              CASE WHEN NOT acts THEN found WHEN op = 'M' THEN list_append(found, {seen.format(key='CASE WHEN is_new THEN minted + 1 ELSE key END', added='is_new OR enrols')})
                                ELSE list_transform(range(1, len(found) + 1), lambda i: CASE WHEN i = tasks[slot].i THEN {seen.format(key='CASE WHEN is_new THEN minted + 1 ELSE key END', added='is_new OR enrols')} ELSE found[i] END) END AS found
                            FROM (SELECT *, CASE WHEN acts AND enrols THEN {goes} END AS goes
                              FROM (SELECT *, CASE WHEN acts AND enrols THEN list_append(own, {row.format(key='key')}) ELSE []::{template}[] END AS grown
                                FROM (SELECT *, coalesce(acts AND NOT is_new AND cos >= {k.match_threshold + k.enrol_confidence} AND cos < {k.enrol_max_cosine} AND coalesce(cos - rival >= {k.enrol_margin}, true)
                                      AND (len(own) < {k.template_cap} OR cos < {crowded}) AND NOT coalesce(likeness < {k.clothing_clash}, false), false) AS enrols
                                  FROM (SELECT *, best.key AS key, -best.c AS cos, coalesce(-best.c < {k.match_threshold}, true) AS is_new, CASE WHEN acts THEN {of_key('people', 'best.key')} ELSE []::{template}[] END AS own,
                                      CASE WHEN acts THEN list_max(list_transform(list_filter(people, lambda p: p.key <> best.key), lambda p: {cosine('p.vec', 'y.vec')})) END AS rival,
                                      CASE WHEN acts THEN list_max(list_transform(list_filter(people, lambda p: p.key = best.key AND p.look IS NOT NULL AND y.look IS NOT NULL), lambda p: {d.overlap('p.look', 'y.look')})) END AS likeness
                                    FROM (SELECT * EXCLUDE (people0), people0 AS people, CASE WHEN acts THEN list_sort(list_transform(list_filter(people0, lambda p: p.key IS DISTINCT FROM without),
                                          lambda p: struct_pack(c := -{cosine('p.vec', 'y.vec')}, id := p.id, key := p.key)))[1] END AS best
                                      -- 2: whom M or S match, and what a wrong match had learnt is forgotten.
                                      FROM (SELECT * EXCLUDE (people), CASE WHEN op = 'S' AND acts AND y.added AND len(list_filter(people, lambda p: p.key = y.key)) > 1 THEN list_filter(people, lambda p: p.id <> y.id) ELSE people END AS people0,
                                          CASE WHEN op = 'S' THEN y.key END AS without
                                        FROM (SELECT *, CASE WHEN op = 'M' THEN true WHEN op = 'S' AND slot <= len(tasks) THEN coalesce(keeper.body <> y.body AND {d.overlap('keeper.look', 'y.look')} < {k.same_frame_clothing}, false) ELSE false END AS acts
                                          FROM (SELECT *, CASE op WHEN 'M' THEN struct_pack(n := x.n, id := x.id, vec := x.vec, quality := x.quality, look := x.look, track := x.track, body := x.body, key := NULL::BIGINT, is_new := NULL::BOOLEAN,
                                                cos := NULL::DOUBLE, added := NULL::BOOLEAN) WHEN 'S' THEN found[tasks[slot].i] END AS y, CASE WHEN op = 'S' THEN found[tasks[slot].keeper] END AS keeper
                                            -- 1: the next step of the program.
                                            FROM (SELECT * EXCLUDE (tasks), CASE WHEN op = 'S' AND slot = 1 THEN {shared} WHEN op = 'M' THEN []::STRUCT(i BIGINT, keeper BIGINT)[] ELSE tasks END AS tasks
                                              FROM (SELECT s.* EXCLUDE (k, op, frame, found), g.k, g.op, g.frame, g.t, g.slot, g.x, g.q, CASE WHEN s.op IN ('O', '') THEN []::{face}[] ELSE s.found END AS found
                                                FROM step AS s JOIN program AS g ON g.run_id = s.run_id AND g.k = s.k + 1) AS a0) AS a1) AS a2) AS a3) AS a4) AS a5) AS a6) AS a7) AS a8) AS a9) AS b0) AS b1) AS b2) AS b3) AS b4) AS b5) AS b6) AS b7) AS b8) AS b9) AS c0) AS c1)
    SELECT e.run_id, e.frame, e.n, e.id, list_filter(o.found, lambda u: u.n = e.n)[1].key AS key, o.n_people AS people, o.merged, o.healed, o.split, o.vetoed, o.uncertain
    FROM {bindings.encounters(d)} AS e JOIN step AS o ON o.run_id = e.run_id AND o.frame = e.frame AND o.op = 'O'"""


@frames("encounters", oracle=story_sql)
def reconcile_full(k: Settings, encounters: DataFrame) -> DataFrame:
    """The whole story of each run: the key of every face, and the running counts."""
    return fold_in_order(encounters.select(*READ), "run_id", ["frame", "n"], ["frame"], lambda: Story(k), tell, STORY_DDL)


# ---------------------------------------------------------------- stream


class Reconciler(StatefulProcessor):
    """The story of each run in Spark's state store, written back entry by entry.

    Templates, constraints and locks are maps, mints a list, counts a value. Frames
    arrive whole and in order, a run's rows of a batch sorted here. A run without
    rows for ``idle_ms`` is forgotten by a timer.
    """

    def __init__(self, settings: Settings = DEFAULTS, idle_ms: int = 0):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.templates = handle.getMapState("templates", "id long", "key long, vec array<double>, quality double, look array<double>")
        self.pairs = handle.getMapState("pairs", "a long, b long", "apart boolean, asserted boolean")
        self.locks = handle.getMapState("locks", "track long", "key long, look array<double>, at long")
        self.mints = handle.getListState("mints", "track long, key long, look array<double>, at long")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in (*COUNTS, "minted")))

    def _load(self) -> Story:
        story = Story(self.settings)
        array = lambda x: None if x is None else np.asarray(x, float)
        people: dict[int, list[Template]] = {}
        for (i,), (key, vec, quality, look) in self.templates.iterator():
            people.setdefault(key, []).append(Template(i, array(vec), np.nan if quality is None else quality, array(look)))
        for key in sorted(people):
            story.gallery.people[key] = sorted(people[key], key=lambda t: t.id)
        for pair, (apart, asserted) in self.pairs.iterator():
            story.gallery.apart |= {tuple(pair)} if apart else set()
            story.asserted |= {tuple(pair)} if asserted else set()
        for (track,), (key, look, at) in self.locks.iterator():
            story.locks[track] = Mint(key, array(look), at)
        for track, key, look, at in self.mints.get():
            story.mints.setdefault(track, []).append(Mint(key, array(look), at))
        if self.counts.exists():
            *counts, story.gallery.minted = self.counts.get()
            story.counts = dict(zip(COUNTS, counts, strict=True))
        return story

    @staticmethod
    def _entries(story: Story) -> tuple[dict, dict, dict]:
        plain = lambda x: None if x is None else [float(v) for v in x]
        templates = {(t.id,): (key, plain(t.vec), None if np.isnan(t.quality) else t.quality, plain(t.look)) for key, own in story.gallery.people.items() for t in own}
        pairs = {p: (p in story.gallery.apart, p in story.asserted) for p in story.gallery.apart | story.asserted}
        locks = {(t,): (m.key, plain(m.look), m.at) for t, m in story.locks.items()}
        return templates, pairs, locks

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        story = self._load()
        before = self._entries(story)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["frame", "n"])
        out = tell(int(key[0]), batch, story)
        for state, old, new in zip((self.templates, self.pairs, self.locks), before, self._entries(story), strict=True):
            for entry in old.keys() - new.keys():
                state.removeKey(entry)
            for entry, value in new.items():
                if old.get(entry) != value:
                    state.updateValue(entry, value)
        mints = [(t, m.key, None if m.look is None else [float(v) for v in m.look], m.at) for t, own in story.mints.items() for m in own]
        self.mints.put(mints) if mints else self.mints.clear()
        self.counts.update((*(int(story.counts[c]) for c in COUNTS), story.gallery.minted))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STORY_DDL.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.templates, self.pairs, self.locks, self.mints, self.counts):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def reconcile_stream(encounters: DataFrame, settings: Settings = DEFAULTS, idle_ms: int = 0) -> DataFrame:
    """The story of each run as its frames arrive; equal to ``reconcile_full`` over all of them.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return encounters.select(*READ).groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Reconciler(settings, idle_ms), outputStructType=STORY_DDL, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None"
    )
