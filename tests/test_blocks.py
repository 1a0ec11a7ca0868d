"""Searches and siblings by matrices: what the texts give that join all pairs, on rows of every kind."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from turnstile.catalog import apply
from turnstile.operators import blocks, bounds, folds, review
from turnstile.plans.dialect import Dialect
from turnstile.plans.registry import _TEXTS
from turnstile.settings import Settings

SCHEMA = "id long, key long, vec array<double>, quality double, appearance array<double>, staff boolean"
K = Settings(match_threshold=0.5, near_miss_floor=0.4, near_miss_weak=0.2, near_miss_clothes=0.3, template_cap=3)


def people(odd: bool, n: int = 240) -> list[tuple]:
    rng = random.Random(5)
    rows = []
    for i in range(n):
        vec = [rng.gauss(0, 1) for _ in range(8)]
        length = sum(x * x for x in vec) ** 0.5
        look = [rng.random() / 3 for _ in range(6)] if i % 7 else None
        rows.append([i, i % 5 if i < 200 else i, [x / length for x in vec], float(i % 9) if i % 4 else None, look, i % 11 == 0])
    for i in range(0, 60, 2):  # equal vectors, some of other keys
        rows[i + 100][2] = rows[i][2]
    rows[17][0] = 16  # an id twice
    if odd:
        rows[30][2] = None
        rows[31][2] = rows[31][2][:5]
        rows[33][2] = [float("nan"), *rows[33][2][1:]]
        rows[40][2] = [None, *rows[40][2][1:]]
        rows[44][4] = [None, *([0.1] * 5)]
        rows[45][4] = [0.2] * 4
    return [tuple(r) for r in rows]


def full(spark, name, **views):
    """The text as it joins all pairs."""
    for view, df in views.items():
        df.createOrReplaceTempView(f"full_{view}")
    return spark.sql(_TEXTS[name](Dialect(spark=True, k=K, views={v: f"full_{v}" for v in views})))


@pytest.mark.parametrize("odd,sizes", [(False, (3, 50, 16, 4)), (True, (3, 50, 16, 4)), (True, (48, 65536, 4096, 64))])
def test_searches_equal_the_join_of_all_pairs(spark, odd, sizes, monkeypatch):
    for name, size in zip(("BLOCKS", "BLOCK_ROWS", "PART_ROWS", "FEW"), sizes, strict=True):
        monkeypatch.setattr(blocks, name, size)
    rows = people(odd)
    gallery, probes = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::3], SCHEMA)
    apart = spark.createDataFrame([(0, 1)], "a long, b long")
    given = {"probes": probes, "gallery": gallery, "cannot_link": apart}
    names = ["cosine_top1", "cosine_top1_exclude", "runner_up", "match_verdict", "enrol_clauses", "best_intersection", "enrol_veto", "near_miss", "overlap"]
    for name in names if sizes[0] == 3 else names[:4]:
        got, want = ([str(tuple(r)) for r in df.collect()] for df in (apply(name, K, **given), full(spark, name, **given)))
        assert sorted(got) == sorted(want), name
    for name in ("redundancy_max", "prune_redundant_step"):
        got, want = ([str(tuple(r)) for r in df.collect()] for df in (apply(name, K, templates=gallery), full(spark, name, templates=gallery)))
        assert sorted(got) == sorted(want), name


def test_searches_score_no_pair_in_rows(spark):
    """Pairs of a search and of a large key meet as matrices: no plan joins them."""
    gallery = spark.createDataFrame(people(False), SCHEMA)
    for name in ("cosine_top1", "runner_up", "match_verdict", "overlap"):
        views = {"probes": gallery.limit(20), "gallery": gallery} | ({"cannot_link": spark.createDataFrame([(0, 1)], "a long, b long")} if name == "overlap" else {})
        assert "zip_with" not in apply(name, K, **views)._jdf.queryExecution().toString()


@pytest.mark.parametrize("odd,sizes", [(False, (16, 4, 64)), (True, (2, 4, 7)), (True, (8192, 64, 1 << 15))])
def test_clothes_of_a_key_equal_the_join_of_all_pairs(spark, odd, sizes, monkeypatch):
    for name, size in zip(("LOOK_ROWS", "FEW", "TILE"), sizes, strict=True):
        monkeypatch.setattr(blocks, name, size)
    rows = [list(r) for r in people(odd)]
    if odd:
        rows[45][4] = [float("nan"), *([0.1] * 5)]
        rows[46][1] = None
        for r in rows[200:210]:  # two keys of few rows
            r[1] = 200 + r[0] % 2
    templates = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    got, want = apply("hist_intersection", K, templates=templates), full(spark, "hist_intersection", templates=templates)
    assert got.dtypes == want.dtypes
    got_rows, want_rows = ([str(tuple(r)) for r in df.collect()] for df in (got, want))
    assert len(got_rows) > 2000 and sorted(got_rows) == sorted(want_rows)
    if not odd:  # pairs were scored one by one in a join whose tasks were whole keys
        assert "zip_with" not in got._jdf.queryExecution().toString()
    longer = templates.union(spark.createDataFrame([(900, 1, None, None, [0.1] * 7, False)], SCHEMA))
    with pytest.raises(Exception, match="differ in length"):
        apply("hist_intersection", K, templates=longer).collect()


def test_overlaps_come_a_tile_at_a_time(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 50)
    rng = np.random.default_rng(6)
    ids, others, looks, other_looks = rng.permutation(40), np.sort(rng.permutation(np.arange(40, 200))[:120]), rng.random((40, 6)), rng.random((120, 6))
    found = list(blocks.overlaps(ids, looks, others, other_looks.T, False))
    assert max(len(f[0]) for f in found) <= 50
    got = {(a, b): c for f in found for a, b, c in zip(*(x.tolist() for x in f), strict=True)}
    assert got == {(i, j): round(sum(map(min, x, y)), 6) for i, x in zip(ids.tolist(), looks.tolist(), strict=True) for j, y in zip(others.tolist(), other_looks.tolist(), strict=True)}


def test_six_digits_are_those_of_sql(spark):
    rng = np.random.default_rng(7)
    ties = [(2 * k + 1) / 2e6 for k in rng.integers(-(10**6), 10**6, 3000).tolist()]
    near = [float(np.nextafter(x, s)) for x in ties[:500] for s in (-9, 9)]
    x = np.array([*ties, *near, *rng.random(3000), *(rng.random(1000) * 1e9), -1e-9, 0.0, 1e15 + 0.5, 123456789.0000005])
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x.tolist()], "x double").selectExpr("round(x, 6)").collect()]
    assert [repr(v) for v in blocks.six_digits(x).tolist()] == [repr(v) for v in want]


def test_a_descriptor_is_added_up_once(spark):
    """Spark added up all numbers again for each number."""
    look = Dialect(spark=True).shares("a")
    assert spark.sql(f"SELECT {look} FROM VALUES (array(1.0D, 2.0D, 5.0D)), (array()), (array(1.0D, NULL)) AS t(a)").collect() == [([0.125, 0.25, 0.625],), ([],), ([None, None],)]
    assert look.index("aggregate") < look.index("whole ->") and look.count("aggregate") == 1


def test_pruning_looks_again_only_where_it_must(monkeypatch):
    """Every eviction took a whole product of its key; now rows that go are as scoring anew says, ties included."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, cap = int(rng.integers(2, 120)), int(rng.integers(1, 6))
        vec = rng.normal(size=(n, 8))
        vec /= np.linalg.norm(vec, axis=1)[:, None]
        vec[rng.integers(0, n, n // 3)] = vec[rng.integers(0, n)]
        monkeypatch.setattr(folds, "NEAREST", int(rng.integers(1, 33)))
        rows = [folds.Template(i, vec[i], float(rng.integers(0, 4)) if rng.random() < 0.8 else float("nan"), None) for i in range(n)]
        want = list(rows)
        while len(want) > cap:
            near = folds.closest_siblings(want)
            quality = [-np.inf if np.isnan(t.quality) else t.quality for t in want]
            want.pop(max(range(len(want)), key=lambda i: (near[i], -quality[i], want[i].id)))
        assert [t.id for t in folds.prune_redundant(rows, cap)] == [t.id for t in want]
    seen, look = [], folds.Siblings.look
    monkeypatch.setattr(folds, "NEAREST", 32)
    monkeypatch.setattr(folds.Siblings, "look", lambda self, own: (seen.append(len(own) * int(self.here.sum())), look(self, own))[1])
    vec = rng.normal(size=(1500, 64))
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    assert len(folds.prune_redundant([folds.Template(i, v, 1.0, None) for i, v in enumerate(vec)], 5)) == 5
    assert sum(seen) < 3 * 1500**2


def test_one_template_galleries_fold_as_the_text_does(spark):
    rows = [(r[0] if i != 17 else 1000, i % 2, r[2]) for i, r in enumerate(people(False)[:120])]
    templates = spark.createDataFrame(rows, "id long, run_id long, vec array<double>")
    got, want = ([str(tuple(r)) for r in df.collect()] for df in (apply("gallery_fold_cap1", K, templates=templates), full(spark, "gallery_fold_cap1", templates=templates)))
    assert sorted(got) == sorted(want)
    assert "aggregate" not in apply("gallery_fold_cap1", K, templates=templates)._jdf.queryExecution().toString()


def test_a_frame_costs_a_tracker_little_and_old_checkpoints_open():
    rng = np.random.default_rng(2)
    frames = [np.c_[rng.integers(0, 120, (4, 2)), rng.integers(40, 140, (4, 2))] for _ in range(1500)]
    tracker, start = folds.Tracker(), time.process_time()
    for boxes in frames:
        tracker.step(boxes)
    assert time.process_time() - start < 1500 * 3e-4
    old = folds.Tracker.__new__(folds.Tracker)
    old.__setstate__({"settings": tracker.settings, "state": tracker.state, "frame": tracker.frame, "born": tracker.born})
    assert old.step(frames[0]) == tracker.step(frames[0]) and (old.state == tracker.state).all()


def test_pictures_stay_in_their_tasks(spark):
    images = spark.createDataFrame([(1, bytearray(48 * 40 * 3), 48, 40)], "image_id long, pixels binary, width int, height int")
    plan = apply("image_signals", K, images=images)._jdf.queryExecution().optimizedPlan().toString()
    assert "boxed.pixels" not in plan and ".pixels" not in plan


def test_cells_are_asked_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(bounds, "ASKED", 64)
    gallery = spark.createDataFrame(people(False), SCHEMA).select("id", "key", "vec")
    cells = bounds.Cells(gallery, 10)
    batch = gallery.selectExpr("id AS probe", "vec", "-1.0D AS best").toPandas()
    met = list(cells._meets(batch, False))
    assert sum(len(some) for some, _, _ in met) == len(batch) and max(len(at) for _, at, _ in met) <= 64
    each = sum(int(cells.size[cell].sum()) for _, _, cell in met)
    assert cells.pairs(gallery.selectExpr("id AS probe", "vec", "-1.0D AS best")) == each


def test_blocks_of_the_review_queue_grow_with_the_table(spark):
    """Each template was sent once for every 2,048 templates."""
    templates = spark.range(300_000).selectExpr("id", "id % 7 AS key", "array(1.0D) AS vec")
    assert "cast(24 as bigint)" in review.closest_keys(templates, 0.0)._jdf.queryExecution().analyzed().toString()


def test_maxima_of_keys_survive_small_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    keys, vec, block = rng.integers(0, 9, 80), rng.normal(size=(80, 4)), rng.integers(0, 2, 80)
    table = pa.table({"key": keys, "vec": vec.tolist(), "block": block})
    want = {}
    for i in range(80):
        for j in range(80):
            if keys[i] < keys[j]:
                pair = (int(keys[i]), int(keys[j]))
                want[pair] = max(want.get(pair, -9.0), float(vec[i] @ vec[j]))
    monkeypatch.setattr(review, "HELD", 100)
    got = {}
    for low, high in ((0, 0), (0, 1), (1, 1)):
        for a, b, c in review.key_maxima(table, low, high, -9.0):
            got[a, b] = max(got.get((a, b), -9.0), c)
    assert got == pytest.approx(want)
