"""Reconciliation: guards of the story one by one, batch against stream, and merges as components."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstile.catalog import apply
from turnstile.operators import merging
from turnstile.operators.folds import Template
from turnstile.operators.stories import COUNTS, Face, Story, different_bodies, reconcile_stream
from turnstile.settings import Settings

RED, BLUE = np.eye(48)[0], np.eye(48)[1]
#: Half red: neither a clash with red nor like it.
MAUVE = (RED + BLUE) / 2


def axis(*parts):
    v = np.zeros(16)
    for i, x in parts:
        v[i] = x
    return v


A = axis((0, 1.0))
STRANGER = [axis((i, 1.0)) for i in range(5, 16)]


def near(cosine, k):
    """A view of A's person at this cosine."""
    return axis((0, cosine), (k, np.sqrt(1 - cosine**2)))


def seen(number, vec, track=None, body=None, look=None, staff=False):
    return Face(Template(number, vec, 90.0, look), track, body, staff)


def counts(story):
    return {c: n for c, n in story.counts.items() if n}


def test_a_later_match_heals_the_mint_of_its_track():
    s = Story()
    s.frame(0, [seen(1, A, 1)])
    assert s.frame(500, [seen(2, STRANGER[0], 2)]) == [2] and s.counts["people"] == 2
    assert s.frame(1000, [seen(3, near(0.6, 1), 2)]) == [1]
    assert counts(s) == {"people": 1, "healed": 1} and set(s.gallery.people) == {1} and s.mints.get(2) is None


def test_a_double_mint_settles_on_the_one_that_is_matched():
    s = Story()
    s.frame(0, [seen(1, STRANGER[0], 4)])
    s.frame(500, [seen(2, STRANGER[1], 4)])
    s.frame(1000, [seen(3, axis((6, 0.8), (1, 0.6)), 4)])
    assert counts(s) == {"people": 1, "healed": 1} and set(s.gallery.people) == {2}
    assert [m.key for m in s.mints[4]] == [2]  # the matched key's own entry stays


@pytest.mark.parametrize("cosine,late,healed", [(0.46, 500, 1), (0.44, 500, 0), (0.6, 20_000, 1), (0.6, 20_001, 0)])
def test_heals_need_a_strong_match_within_the_window(cosine, late, healed):
    s = Story()
    s.frame(0, [seen(1, A, 1)])
    s.frame(1000, [seen(2, STRANGER[0], 2)])
    s.frame(1000 + late, [seen(3, near(cosine, 1), 2)])
    assert s.counts["healed"] == healed


def test_a_refused_heal_is_not_tried_again():
    s = Story()
    s.frame(0, [seen(1, A, 1)])
    s.frame(500, [seen(2, STRANGER[0], 2)])
    s.gallery.people[2] = [*s.gallery.people[2], Template(99, STRANGER[0], 1.0, None)]  # seen again: no junk
    s.frame(1000, [seen(3, near(0.6, 1), 2)])
    s.gallery.people[2] = s.gallery.people[2][:1]
    s.frame(1500, [seen(4, near(0.6, 2), 2)])
    assert counts(s) == {"people": 2}


def test_clashing_clothes_veto_a_heal_and_its_entry_goes():
    s = Story()
    s.frame(0, [seen(1, A, 1, look=BLUE)])
    s.frame(500, [seen(2, STRANGER[0], 2, look=RED)])
    s.frame(1000, [seen(3, near(0.6, 1), 2, look=BLUE)])
    assert counts(s) == {"people": 2, "vetoed": 1} and 2 not in s.mints
    s.frame(1500, [seen(4, near(0.6, 2), 2, look=RED)])
    assert counts(s) == {"people": 2, "vetoed": 1}


@pytest.mark.parametrize("before,now,want", [(RED, MAUVE, {"uncertain": 1}), (RED, RED, {}), (None, BLUE, {}), (RED, None, {})])
def test_uncertain_or_unknown_clothes_veto_nothing(before, now, want):
    s = Story()
    s.frame(0, [seen(1, A, 1)])
    s.frame(500, [seen(2, STRANGER[0], 2, look=before)])
    s.frame(1000, [seen(3, near(0.6, 1), 2, look=now)])
    assert counts(s) == {"people": 1, "healed": 1} | want


def locked():
    """A story whose track 7 is locked to key 1 in red clothes."""
    s = Story()
    s.frame(0, [seen(1, A, 7, look=RED)])
    s.frame(500, [seen(2, near(0.6, 1), 7, look=RED)])
    assert s.locks[7].key == 1
    return s


def test_a_mint_folds_into_its_tracks_lock():
    s = locked()
    assert s.frame(1000, [seen(3, STRANGER[0], 7)]) == [1]
    assert counts(s) == {"people": 1, "merged": 1} and 7 not in {t for t, own in s.mints.items() if any(m.key == 2 for m in own)}
    assert s.frame(21_500, [seen(4, STRANGER[1], 7)]) == [3]  # the lock is old
    assert counts(s) == {"people": 2, "merged": 1} and not s.locks


def test_a_clash_drops_the_lock():
    s = locked()
    s.frame(1000, [seen(3, STRANGER[0], 7, look=BLUE)])
    assert counts(s) == {"people": 2, "vetoed": 1} and not s.locks
    s.frame(1500, [seen(4, STRANGER[1], 7, look=RED)])  # nothing to fold into any more
    assert counts(s) == {"people": 3, "vetoed": 1}


def test_a_lock_whose_person_stands_elsewhere_folds_nothing():
    s = locked()
    s.frame(1000, [seen(3, near(0.6, 2), 8, body=1), seen(4, STRANGER[0], 7, body=2)])
    assert s.counts["merged"] == 0 and s.locks[7].key == 1 and (1, 2) in s.gallery.apart
    t = locked()  # a face on a phone: the same body
    t.frame(1000, [seen(3, near(0.6, 2), 8, body=1), seen(4, STRANGER[0], 7, body=1)])
    assert t.counts["merged"] == 1 and not t.gallery.apart


def test_two_bodies_of_a_frame_never_become_one():
    s = Story()
    s.frame(0, [seen(1, A, 1, body=1), seen(2, STRANGER[0], 2, body=2)])
    assert (1, 2) in s.gallery.apart
    s.frame(1000, [seen(3, near(0.6, 1), 2, body=5)])
    assert counts(s) == {"people": 2}
    one = Story()  # one body with two faces asserts nothing
    one.frame(0, [seen(1, A, 1, body=1), seen(2, STRANGER[0], 2, body=1)])
    assert not one.gallery.apart
    one.frame(1000, [seen(3, near(0.6, 1), 2, body=5)])
    assert counts(one) == {"people": 1, "healed": 1}


def test_body_sets():
    assert different_bodies({1: {1}, 2: {2}}, 1, 2) and not different_bodies({1: {1, 3}, 2: {3}}, 1, 2)
    assert different_bodies({1: {None}, 2: {2}}, 1, 2) and different_bodies({1: {2, None}, 2: {2}}, 1, 2)
    assert not different_bodies({1: {1}}, 1, 2)


def test_one_key_on_two_bodies_is_split_only_if_clothes_clash():
    for look, body, want in [(BLUE, 2, 1), (RED, 2, 0), (BLUE, None, 0), (None, 2, 0), (BLUE, 1, 0)]:
        s = Story()
        s.frame(0, [seen(1, A, 1)])
        keys = s.frame(500, [seen(2, near(0.7, 1), 1, body=1, look=RED), seen(3, near(0.6, 2), 2, body=body, look=look)])
        assert s.counts["split"] == want and keys == [1, 2 if want else 1]
        assert 3 not in [t.id for t in s.gallery.people[1]] or not want  # what the wrong match learnt is gone


def test_staff_are_nobody():
    s = Story()
    assert s.frame(0, [seen(1, A, 1, body=1, staff=True), seen(2, STRANGER[0], 1, body=2)]) == [None, 1]
    assert counts(s) == {"people": 1} and not s.gallery.apart and len(s.gallery.people) == 1


def test_the_pairs_of_a_run_are_capped():
    s = Story(Settings(co_presence_cap=2))
    s.frame(0, [seen(i, v, body=i) for i, v in enumerate(STRANGER[:4], 1)])
    assert s.gallery.apart == {(1, 2), (1, 3)}


# ---------------------------------------------------------------- batch and stream

ENCOUNTERS = "run_id long, frame long, t_ms long, n long, track long, body long, staff boolean, id long, vec array<double>, quality double, appearance array<double>"


def encounters(runs=3, frames=24, seed=7):
    """People who come and go over two tracks a run, blurred now and then, in clothes that are sometimes unknown."""
    rng = np.random.default_rng(seed)
    rows, number = [], 0
    for run in range(runs):
        people = [axis((2 * i, 1.0)) for i in range(4)]
        clothes = [np.eye(48)[i] for i in range(4)]
        for frame in range(frames):
            for n in range(int(rng.integers(1, 4))):
                number += 1
                who = int(rng.integers(0, 4))
                blur = rng.choice([0.05, 0.6, 1.6])
                vec = people[who] + blur * rng.normal(size=16) / 4
                mix = rng.choice([0.9, 0.5, 0.2])
                look = None if rng.random() < 0.2 else (mix * clothes[who] + (1 - mix) * clothes[int(rng.integers(0, 4))]).tolist()
                track = None if rng.random() < 0.1 else int(rng.integers(0, 2))
                body = None if rng.random() < 0.1 else n - (n == 2 and rng.random() < 0.3)
                rows.append((run, frame, frame * 700, n, track, body, bool(rng.random() < 0.05), number, (vec / np.linalg.norm(vec)).tolist(), float(rng.integers(40, 120)), look))
    return rows


def told(rows):
    """The stories frame by frame, without Spark."""
    out, stories = [], {}
    for (run, frame), own in pd.DataFrame(rows, columns=[c.split()[0] for c in ENCOUNTERS.split(", ")]).groupby(["run_id", "frame"]):
        story = stories.setdefault(run, Story())
        number = lambda x: None if x is None or x != x else int(x)
        look = lambda x: None if x is None else np.array(x)
        faces = [Face(Template(r.id, np.array(r.vec), r.quality, look(r.appearance)), number(r.track), number(r.body), r.staff) for r in own.sort_values("n").itertuples()]
        for f, key in zip(faces, story.frame(int(own["t_ms"].iloc[0]), faces), strict=True):
            out.append((run, frame, f.template.id, key, *(story.counts[c] for c in COUNTS)))
    return sorted(out, key=repr)


def compared(df):
    return sorted(((r.run_id, r.frame, r.id, r.key, *(r[c] for c in COUNTS)) for r in df.collect()), key=repr)


def test_batch_equals_the_story(spark):
    rows = encounters()
    want = told(rows)
    got = compared(apply("reconcile_full", encounters=spark.createDataFrame(rows, ENCOUNTERS).repartition(5)))
    assert [tuple(map(int_or_none, r)) for r in got] == [tuple(map(int_or_none, r)) for r in want]
    last = {r[0]: r for r in want}
    assert all(any(r[k] for r in last.values()) for k in range(4, 10)), "each count occurs"


def int_or_none(x):
    return None if x is None else int(x)


def test_settings_reach_the_story(spark):
    rows = encounters(runs=1)
    df = spark.createDataFrame(rows, ENCOUNTERS)
    never = apply("reconcile_full", Settings(heal_cosine=2.0, lock_cosine=2.0, same_frame_clothing=0.0), encounters=df).collect()
    assert not any(r.healed or r.merged or r.split for r in never)


def test_stream_equals_batch(spark, tmp_path):
    """Frames in several micro-batches, the query stopped and started between them."""
    rows = encounters()
    want = compared(apply("reconcile_full", encounters=spark.createDataFrame(rows, ENCOUNTERS)))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((0, 7), (7, 8), (8, 24)):
            spark.createDataFrame([r for r in rows if low <= r[1] < high], ENCOUNTERS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(ENCOUNTERS).parquet(source)
            query = reconcile_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(180), "the stream did not end"
    finally:
        spark.conf.set(key, before)
    assert compared(spark.read.parquet(out)) == want


# ---------------------------------------------------------------- merges


def merged(keys, asked, apart):
    """The rules one after the other, with sets: key -> where it ends, and the merges refused."""
    refused, edges = {}, {}
    for keep, gone in sorted(asked):
        if keep == gone:
            refused[keep, gone] = "same-key"
        elif keep not in keys or gone not in keys:
            refused[keep, gone] = "unknown-key"
        elif (min(keep, gone), max(keep, gone)) in apart:
            refused[keep, gone] = "cannot-link"
        elif gone in edges:
            refused[keep, gone] = "two-keepers"
        else:
            edges[gone] = keep
    for start in sorted(edges):
        path = [start]
        while path[-1] in edges and edges[path[-1]] not in path:
            path.append(edges[path[-1]])
        if path[-1] in edges:
            ring = path[path.index(edges[path[-1]]) :]
            refused[edges[min(ring)], min(ring)] = "ring"
            del edges[min(ring)]

    def end(x):
        while x in edges:
            x = edges[x]
        return x

    while True:
        stay = {b if b in edges else a for a, b in apart if end(a) == end(b)}
        if not stay:
            return {k: end(k) for k in keys}, refused
        for x in stay:
            refused[edges.pop(x), x] = "cannot-link"


def merge_frames(spark, keys, asked, apart, only=False):
    templates = [(100 * k + i, k, np.roll(A, k).tolist(), 80.0 + i, None) for k in keys for i in range(keys[k])]
    return {
        "templates": spark.createDataFrame(templates, "id long, key long, vec array<double>, quality double, appearance array<double>"),
        "merges": spark.createDataFrame([(a, b, only) for a, b in asked], "keep long, gone long, only_singleton boolean"),
        "cannot_link": spark.createDataFrame([tuple(p) for p in apart], "a long, b long"),
    }


def answers(spark, keys, asked, apart):
    """Where each key ends, and what was refused."""
    found = merging.resolve(**merge_frames(spark, keys, asked, apart)).collect()
    ends = {r.gone: r.root for r in found if r.reason is None}
    return {k: ends.get(k, k) for k in keys}, {(r.keep, r.gone): r.reason for r in found if r.reason}


def test_chains_end_at_their_last_keeper(spark):
    keys = {k: 1 for k in range(1, 41)}
    chain = [(k + 1, k) for k in range(1, 30)]
    where, refused = answers(spark, keys, [(20, 10), (30, 20), (30, 10)], set())
    assert (where[10], where[20], where[30]) == (30, 30, 30) and refused == {(30, 10): "two-keepers"}
    where, refused = answers(spark, keys, chain, set())
    assert not refused and {where[k] for k in range(1, 31)} == {30} and where[31] == 31
    counted = Counter(r.id for r in apply("merge_apply", **merge_frames(spark, keys, chain, set())).collect())
    assert max(counted.values()) == 1 and len(counted) == 10 + 5  # thirty templates of one key, pruned to five


def test_rings_and_pairs_that_stay_apart(spark):
    keys = {k: 1 for k in range(1, 12)}
    where, refused = answers(spark, keys, [(2, 1), (3, 2), (1, 3), (1, 4)], set())
    assert refused == {(2, 1): "ring"} and where == {k: 1 if k < 5 else k for k in keys}
    # 5 and 7 are apart, and both lead to 9: 7 stays, and with it 8, which was merged into it.
    where, refused = answers(spark, keys, [(6, 5), (9, 6), (9, 7), (7, 8)], {(5, 7)})
    assert refused == {(9, 7): "cannot-link"} and (where[5], where[6], where[7], where[8]) == (9, 9, 7, 7)
    carried = apply("cannot_link_norm", **merge_frames(spark, keys, [(6, 5), (9, 6), (9, 7), (7, 8)], {(5, 7), (8, 10), (1, 2)})).collect()
    assert sorted(map(tuple, carried)) == [(1, 2), (7, 9), (7, 10)]


def test_singletons_only(spark):
    views = merge_frames(spark, {1: 1, 2: 2, 3: 1}, [(1, 2), (1, 3)], set(), only=True)
    assert [tuple(r) for r in apply("merge_refused", **views).collect()] == [(1, 2, "not-singleton")]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 13)), max_size=14), st.sets(st.tuples(st.integers(1, 6), st.integers(7, 12)), max_size=4))
def test_merges_follow_their_rules(spark, asked, apart):
    keys = {k: 1 for k in range(1, 13)}
    where, refused = answers(spark, keys, asked, apart) if asked else (merged(keys, [], apart))
    assert (where, refused) == merged(keys, set(asked), apart)


def test_pointers_reach_any_length_in_a_logarithm_of_rounds(spark, monkeypatch):
    rounds = []
    real = merging.cut
    monkeypatch.setattr(merging, "cut", lambda df: rounds.append(1) or real(df))
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "gone long, keep long")
    ends, ring = merging.roots(edges)
    assert {r.root for r in ends.collect()} == {300} and ring.count() == 0 and len(rounds) <= 11
