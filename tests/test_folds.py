"""Folds on fixtures of known geometry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnstile.functions.columns import iou, jpeg_dims, unit
from turnstile.operators.folds import CX, CY, HITS, VX, VY, Gallery, Template, Tracker, associate, iou_matrix, prune_redundant, track_boxes
from turnstile.settings import Settings
from turnstile.sources.sinks import read_snapshot, settle, upsert, upsert_batches, write_snapshot
from turnstile.streaming.tracks import _advance, crossings_stream, metrics_stream, track_stream


def axis(*parts):
    v = np.zeros(16)
    for i, x in parts:
        v[i] = x
    return v


def probe(cosine, k):
    return axis((0, cosine), (k, np.sqrt(1 - cosine**2)))


def template(i, vec, quality=90.0, look=None):
    return Template(i, vec, quality, look)


def test_threshold_equality_matches():
    g = Gallery()
    g.match(template(1, axis((0, 1.0))))
    assert g.match(template(2, axis((0, 0.363), (1, np.sqrt(1 - 0.363**2)))))["is_new"] is False
    assert g.match(template(3, probe(0.362, 2)))["is_new"] is True


def test_enrolment_needs_confidence_margin_and_freshness():
    g = Gallery()
    g.match(template(1, axis((0, 1.0))))
    assert not g.match(template(2, probe(0.40, 1)))["added"]
    assert g.match(template(3, probe(0.60, 2)))["added"]
    assert not g.match(template(4, probe(0.95, 3)))["added"]


def test_clashing_clothes_veto_the_write_only():
    a, b = np.zeros(48), np.zeros(48)
    a[0], b[1] = 1.0, 1.0
    g = Gallery()
    g.match(template(1, axis((0, 1.0)), look=a))
    v = g.match(template(2, probe(0.6, 1), look=b))
    assert (v["is_new"], v["added"], v["vetoed"]) == (False, False, True)
    assert g.match(template(3, probe(0.6, 2)))["added"]  # unknown clothes veto nothing


def test_prune_scores_anew_and_breaks_ties():
    rows = [template(i, probe(c, i), q) for i, c, q in ((1, 0.9, 90), (2, 0.9, 50), (3, 0.1, 10))]
    assert [t.id for t in prune_redundant(rows, 2)] == [1, 3]


def test_merge_refuses_and_normalises():
    g = Gallery(apart={(1, 3)})
    for i in (1, 2, 3, 5):
        g.people[i] = [template(i, axis((i, 1.0)))]
    assert not g.merge(1, 3) and not g.merge(2, 2) and not g.merge(2, 9)
    assert g.merge(5, 1)
    assert g.apart == {(3, 5)}
    assert not g.merge(3, 5)


def test_tracker_confirms_and_keeps_identity():
    t = Tracker(Settings(track_max_misses=2))
    assert [t.step([(10.0 * i, 0, 40, 80)]) for i in range(4)] == [[(0, 1)]] * 4
    assert t.step([]) == []
    assert t.step([(50.0, 0, 40, 80)]) == [(0, 1)]
    for _ in range(3):
        t.step([])
    assert not len(t.state)


def box(x, y, w=20.0, h=40.0):
    return (float(x), float(y), float(w), float(h))


def test_a_straight_pass_keeps_one_id():
    t = Tracker(Settings(track_max_misses=5))
    assert {n for i in range(12) for _, n in t.step([box(10 + 8 * i, 50)])} == {1}
    assert t.state[0, HITS] == 12


def test_a_ghost_of_one_frame_is_not_reported():
    t = Tracker(Settings(track_max_misses=5))
    for i in range(6):
        t.step([box(10 + i * 8, 50)])
    assert t.step([box(58, 50), box(400, 200)]) == [(0, 1)]
    assert t.step([box(66, 50)]) == [(0, 1)]


def test_a_growing_box_stands_still():
    """Around one centre a box that grows has no motion: corners would see some."""
    t = Tracker()
    for i in range(6):
        t.step([box(100 - 2 * i, 100 - 4 * i, 20 + 4 * i, 40 + 8 * i)])
    assert np.allclose(t.state[0, [VX, VY]], 0) and np.allclose(t.state[0, [CX, CY]], [110, 120])
    # Coasting stays there, so a box of another size at the same centre is the same track.
    t.step([])
    assert t.step([box(80, 80, 60, 80)]) == [(0, 1)]


def test_two_crossing_boxes_hold_their_ids():
    t = Tracker()
    for i in range(20):
        found = t.step([box(10 + 10 * i, 50), box(200 - 10 * i, 75)])
        if i > 2:
            assert found == [(0, 1), (1, 2)]


def test_velocity_takes_the_mean_motion_over_a_gap():
    t = Tracker()
    t.step([box(0, 0)])
    t.step([])
    t.step([box(4, 0)])
    assert t.state[0, VX] == pytest.approx(0.5 * 4 / 2)


def test_greedy_association_is_one_to_one():
    boxes = np.array([(0, 0, 10, 10), (1, 0, 10, 10)], float)
    assert sorted(associate(iou_matrix(boxes, boxes[::-1]), 0.2)) == [(0, 1), (1, 0)]
    assert iou_matrix(np.array([[0.0, 0, 0, 0]]), boxes).max() == 0
    assert iou_matrix(boxes[:1], np.array([[5.0, 0, 10, 10]]))[0, 0] == pytest.approx(50 / 150)


def test_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame(
        [(r, f, n, 10.0 * n + 3 * f, 5.0, 40.0, 80.0) for r in (1, 2) for f in range(6) for n in (1, 2)],
        columns=["run_id", "frame", "n", "x", "y", "w", "h"],
    )
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, frame long, n long, x double, y double, w double, h double").parquet(str(tmp_path / "in"))
    q = track_stream(stream, idle_ms=0).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90), "the stream did not end"
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("tracks").collect()))
    want = sorted(map(tuple, track_boxes(spark.createDataFrame(rows)).collect()))
    assert got == want and got


def test_snapshots_and_upserts(spark, tmp_path):
    root = str(tmp_path / "t")
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    assert write_snapshot(old, root) == 1
    new = spark.createDataFrame([(2, 1, "c"), (3, 0, "d")], "k int, v int, x string")
    assert write_snapshot(upsert(read_snapshot(spark, root), new, ["k"], "v"), root) == 2
    assert sorted(map(tuple, read_snapshot(spark, root).collect())) == [(1, 1, "a"), (2, 1, "c"), (3, 0, "d")]


def test_columns(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (0.0, 5.0, 10.0, 10.0))], "a struct<x:double,y:double,w:double,h:double>, b struct<x:double,y:double,w:double,h:double>")
    assert df.select(iou(F.col("a"), F.col("b")).alias("o")).first().o == pytest.approx(1 / 3)
    got = spark.createDataFrame([([3.0] + [0.0] * 7,), ([0.0] * 8,)], "v array<double>").select(unit("v").alias("u")).collect()
    assert got[0].u[0] == 1.0 and got[1].u is None


def test_jpeg_header():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04\x03"
    assert jpeg_dims(head) == (0x0304, 0x0102)
    assert jpeg_dims(b"nothing") is None and jpeg_dims(None) is None


def test_settings_refuse_garbage(monkeypatch):
    monkeypatch.setenv("TURNSTILE_TEMPLATE_CAP", "")
    assert Settings.from_env().template_cap == 5
    monkeypatch.setenv("TURNSTILE_TEMPLATE_CAP", "many")
    with pytest.raises(ValueError):
        Settings.from_env()


def run_stream(stream, path, name, mode="append", **options):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90), "the stream did not end"
    finally:
        q.stop()


def test_crossings_and_metrics_streams(spark, tmp_path):
    hours = [0, 1, 2, 20, 21, 60]
    rows = [(7, 1, "click", 2.0 * h, (pd.Timestamp("2026-01-01") + pd.Timedelta(hours=h)).to_pydatetime()) for h in hours]
    spark.createDataFrame(rows, "track long, run_id long, stage string, value double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("track long, run_id long, stage string, value double, ts timestamp").parquet(str(tmp_path / "in"))
    run_stream(crossings_stream(read(), "6 hours"), str(tmp_path / "c1"), "crossings")
    got = sorted((r.first.hour, r.face_frames) for r in spark.table("crossings").collect())
    assert got == [(0, 3), (20, 2)]  # the session of hour 60 is still open
    run_stream(metrics_stream(read(), "6 hours"), str(tmp_path / "c2"), "metrics")
    got = sorted((r.flush.day, r.flush.hour, r.n, r.least, r.mean, r.most) for r in spark.table("metrics").collect())
    assert got == [(1, 0, 3, 0.0, 2.0, 4.0), (1, 18, 2, 40.0, 41.0, 42.0)]


def test_idle_trackers_are_dropped():
    class State:
        exists, hasTimedOut, get, waits = False, False, (None,), None

        def update(self, value):
            self.get, self.exists = value, True

        def setTimeoutDuration(self, ms):
            self.waits = ms

        def remove(self):
            self.exists = False

    frame = lambda n: pd.DataFrame({"run_id": 1, "frame": [n], "n": [1], "x": [1.0 * n], "y": [0.0], "w": [9.0], "h": [9.0]})
    state = State()
    out = [r for n in range(3) for df in _advance((1,), iter([frame(n)]), state, 500) for r in df.itertuples(index=False, name=None)]
    assert [r[3] for r in out] == [1, 1, 1] and state.waits == 500
    state.hasTimedOut = True
    assert list(_advance((1,), iter([]), state, 500)) == [] and not state.exists
    state.hasTimedOut = False
    again = [r for df in _advance((1,), iter([frame(9)]), state, 0) for r in df.itertuples(index=False, name=None)]
    assert [r[3] for r in again] == [1]  # a new tracker numbers anew


def test_upsert_batches_rewrite_what_they_touch(spark, tmp_path):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=4)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v int, x string")
    write(batch(*[(i, 1, "a") for i in range(40)]), 0)
    write(batch((3, 2, "b"), (99, 1, "c")), 1)
    write(batch((3, 2, "b"), (99, 1, "c")), 1)  # a repeated batch changes nothing
    write(batch((3, 1, "late")), 2)
    got = {r.k: (r.v, r.x) for r in read_snapshot(spark, root).collect()}
    assert got == {i: (1, "a") for i in range(40)} | {3: (2, "b"), 99: (1, "c")}


def test_chunks_that_were_refused_are_queued_again(spark):
    queue = spark.createDataFrame([(1, i, 0 if i < 8 else 4) for i in range(10)], "run_id long, seq long, tries int")
    answers = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "run_id long, chunk long, ok boolean")
    done, again = settle(queue, answers, ["seq"], chunk=3)
    assert sorted(r.seq for r in done.collect()) == [0, 4, 5, 6, 8, 9]  # those that had been refused before went first
    assert sorted((r.seq, r.tries) for r in again.collect()) == [(1, 1), (2, 1), (3, 1), (7, 1)]
