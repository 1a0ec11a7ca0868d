"""Operators reach every row of their tables: against plain Python over whole tables."""

from collections import Counter

import numpy as np
import pytest

from turnstile import catalog
from turnstile.settings import DEFAULTS as K
from turnstile.sources.bindings import ZONES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def templates(spark):
    return sorted(spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding IS NOT NULL").collect(), key=lambda r: r.vec_id)


def test_probes_meet_all_other_templates_of_all_runs(spark, templates):
    ids = np.array([r.vec_id for r in templates])
    labels = np.array([r.label for r in templates])
    keys = labels * 6 + ids % 6
    vectors = np.array([r.embedding for r in templates], np.float64)
    best, staff, rivals = {}, {}, {}
    for i in np.flatnonzero(ids % 10 == 0):
        cosine = vectors @ vectors[i]
        cosine[i] = -np.inf
        top = int(cosine.argmax())
        best[ids[i]] = (ids[top], round(cosine[top], 6))
        staff[ids[i]] = cosine[labels == 9].max(initial=-np.inf)
        rivals[ids[i]] = round(cosine[keys != keys[top]].max(), 6)
    got = {r.probe: r for r in catalog.queries()["cosine_top1"](spark, SF).collect()}
    assert {p: r.id for p, r in got.items()} == {p: i for p, (i, _) in best.items()}
    assert all(abs(r.cosine - best[p][1]) < 2e-6 for p, r in got.items())
    assert any(r.id % 4 != p % 4 for p, r in got.items())
    assert all(abs(r.rival_cosine - rivals[r.probe]) < 2e-6 for r in catalog.queries()["runner_up"](spark, SF).collect())
    for r in catalog.queries()["match_verdict"](spark, SF).collect():
        want = "staff" if staff[r.probe] >= K.match_threshold else "match" if best[r.probe][1] >= K.match_threshold else "mint"
        assert r.verdict == want


def inside(x, y, points):
    odd = False
    for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1], strict=True):
        odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi
    return odd


def test_all_boxes_meet_the_zones(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    want = Counter((r[0], label) for r in rows for label, _, _, points in ZONES if inside(float(r[1] % 120), float(r[2] % 60), points))
    got = catalog.queries()["point_in_polygon"](spark, SF).collect()
    assert Counter((r.frame, r.label) for r in got) == want
    assert any(r.n > 1 for r in got)


def test_singletons_count_all_templates(spark, templates):
    want = Counter(r.label * 6 + r.vec_id % 6 for r in templates)
    got = catalog.queries()["merge_only_singletons"](spark, SF).collect()
    assert {r.key: (r.n, r.foldable) for r in got} == {k: (n, n == 1) for k, n in want.items()}
