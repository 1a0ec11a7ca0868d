"""Live parts: stalls and repeats on a stream, a source that drops, feedback that counts once, a search that leaves out."""

import os

import numpy as np
import pandas as pd
import pytest

from turnstile.catalog import apply
from turnstile.operators import bounds
from turnstile.settings import Settings
from turnstile.sources.cameras import FrameReader, FrameSource
from turnstile.sources.sinks import manifest, read_snapshot
from turnstile.streaming.feedback import apply_feedback
from turnstile.streaming.watch import new_frames, stalls_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def at(seconds):
    return pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=seconds)


def feed(spark, source, *items):
    rows = [(run, seq, at(s).to_pydatetime()) for run, seq, s in items]
    spark.createDataFrame(rows, "run_id long, seq long, ts timestamp").coalesce(1).write.mode("append").parquet(source)


def drain(df, out, state, mode="append"):
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(180), "the stream did not end"


def read(spark, out):
    return [tuple(r) for r in spark.read.parquet(out).collect()] if os.path.exists(f"{out}/_spark_metadata") else []


def test_silence_is_reported_by_event_time(rocks, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: stalls_stream(rocks.readStream.schema("run_id long, seq long, ts timestamp").parquet(source), Settings(stall_seconds=45))
    feed(rocks, source, (1, 1, 0), (2, 1, 0), (1, 2, 10))
    drain(stream(), out, state)
    feed(rocks, source, (2, 2, 40), (2, 3, 56))  # run 1 has been silent since 10: 46 seconds
    drain(stream(), out, state)
    got = {(r[0], r[1], r[3]) for r in read(rocks, out)}
    assert got == {(1, 2, "source-stalled")}
    feed(rocks, source, (1, 3, 80))
    drain(stream(), out, state)
    feed(rocks, source, (2, 4, 81))
    drain(stream(), out, state)
    got = sorted((r[0], r[1], r[3]) for r in read(rocks, out))
    assert (1, 3, "resumed") in got and got.count((1, 2, "source-stalled")) == 1 and len(got) == 2


def test_silence_is_reported_by_the_clock(rocks, tmp_path):
    """Nothing more comes at all, and the stall is still seen."""
    source = str(tmp_path / "in")
    feed(rocks, source, (1, 7, 0))
    stream = stalls_stream(rocks.readStream.schema("run_id long, seq long, ts timestamp").parquet(source), Settings(stall_seconds=2), by_clock=True)
    query = stream.writeStream.format("memory").queryName("stalls").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if rocks.table("stalls").count():
                break
    finally:
        query.stop()
    assert [(r.run_id, r.seq, r.state) for r in rocks.table("stalls").collect()] == [(1, 7, "source-stalled")]


def test_a_number_passes_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: new_frames(spark.readStream.schema("run_id long, seq long, ts timestamp").parquet(source))
    feed(spark, source, (1, 7, 0), (1, 7, 1), (2, 7, 1))
    drain(stream(), out, state)
    feed(spark, source, (1, 7, 20), (1, 8, 21))  # in another batch, at another time
    drain(stream(), out, state)
    assert sorted((r[0], r[1]) for r in read(spark, out)) == [(1, 7), (1, 8), (2, 7)]


# ---------------------------------------------------------------- source


def shoot(root, run, *numbers):
    os.makedirs(f"{root}/{run}", exist_ok=True)
    for n in numbers:
        with open(f"{root}/{run}/{n}.jpg", "wb") as file:
            file.write(b"frame %d" % n)


def test_frames_are_dropped_never_queued_and_a_restart_goes_on(spark, tmp_path):
    root, out, state = (str(tmp_path / x) for x in ("cameras", "out", "state"))
    spark.dataSource.register(FrameSource)
    shoot(root, "door", 1, 2, 3)
    shoot(root, "hall", 5)
    stream = lambda **more: spark.readStream.format("frames").options(path=root, **more).load()
    drain(stream(), out, state)
    assert sorted(r[:3] for r in read(spark, out)) == [("door", 3, 2), ("hall", 5, 0)]
    shoot(root, "door", 4, 5, 6, 10)
    with open(f"{root}/door/notes.txt", "w") as file:
        file.write("no frame")
    drain(stream(), out, state)  # a new query from the checkpoint
    assert sorted(r[:3] for r in read(spark, out)) == [("door", 3, 2), ("door", 10, 3), ("hall", 5, 0)]
    os.rename(root, f"{root}-away")  # the mount is gone for a while
    drain(stream(), out, state)
    os.rename(f"{root}-away", root)
    shoot(root, "hall", 6)
    drain(stream(), out, state)
    got = sorted(read(spark, out))
    assert [r[:2] for r in got] == [("door", 3), ("door", 10), ("hall", 5), ("hall", 6)] and bytes(got[0][3]) == b"frame 3"
    drain(stream(every="true"), str(tmp_path / "all"), str(tmp_path / "all-state"))
    assert len(read(spark, str(tmp_path / "all"))) == 9


def test_offsets_outlive_frames_that_go(tmp_path):
    root = str(tmp_path)
    shoot(root, "door", 1, 2)
    reader = FrameReader(root)
    first = reader.latestOffset()
    assert [(p.seq, p.skipped) for p in reader.partitions(reader.initialOffset(), first)] == [(2, 1)]
    os.remove(f"{root}/door/2.jpg")
    assert reader.latestOffset() == first and list(reader.partitions(first, first)) == []
    (gone,) = FrameReader(root).partitions({"runs": "{}"}, first)
    assert gone.seq == 1
    os.remove(f"{root}/door/1.jpg")
    assert list(reader.read(gone)) == []


# ---------------------------------------------------------------- feedback


def test_feedback_counts_once(spark, tmp_path):
    root = str(tmp_path / "ledger")
    acted = []

    def act(items):
        got = items.collect()
        acted.extend((r.conv_id, r.turn) for r in got)
        ready = {1, 2, 3} | ({9} if acted.count((9, 1)) > 1 else set())  # item 9 works at its second try
        return spark.createDataFrame([(r.conv_id, r.turn, r.conv_id in ready, f"{r.kind} {r.conv_id}") for r in got], "conv_id long, turn long, settled boolean, effect string")

    items = lambda *ids: spark.createDataFrame([(i, 1, "merge") for i in ids], "conv_id long, turn long, kind string")
    write = apply_feedback(root, act, parts=4)
    write(items(1, 9, 1), 0)
    write(items(1, 9), 0)  # run again after its publish
    assert acted == [(1, 1), (9, 1)] or acted == [(9, 1), (1, 1)]
    state = lambda: {r.conv_id: (r.attempt, r.settled) for r in read_snapshot(spark, root).collect()}
    assert state() == {1: (1, True), 9: (1, False)}

    def dies(items):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        apply_feedback(root, dies, parts=4)(items(2), 1)
    assert state() == {1: (1, True), 9: (1, False)}
    write(items(2, 1), 1)  # the batch again; the settled item is only known again, the open one is tried
    assert state() == {1: (1, True), 9: (2, True), 2: (1, True)} and acted.count((1, 1)) == 1 and acted.count((2, 1)) == 1
    assert {r.effect for r in read_snapshot(spark, root).collect()} == {"merge 1", "merge 2", "merge 9"} and manifest(spark, root).number == 2


# ---------------------------------------------------------------- search

TEMPLATE = "id long, run_id long, key long, label long, vec array<double>, quality double, appearance array<double>, staff boolean"


def crowd(spark, groups, each, spread, scale=False, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 16))
    rows = []
    for i in range(groups * each):
        v = centres[i % groups] + spread * rng.normal(size=16)
        v = v if scale else v / np.linalg.norm(v)
        rows.append((i, 1, i % 50, 0, v.tolist(), 90.0, None, False))
    rows += [(10_000 + i, *rows[i][1:]) for i in range(5)]  # equal vectors tie
    return rows, spark.createDataFrame(rows, TEMPLATE).repartition(4)


@pytest.mark.parametrize("scale", [False, True])
def test_bounds_leave_out_pairs_and_nothing_else(spark, monkeypatch, scale):
    monkeypatch.setattr(bounds, "CELL_ROWS", 16)  # cells are cut into blocks
    rows, gallery = crowd(spark, 20, 40, 0.05, scale)
    probes = spark.createDataFrame([r for r in rows if r[0] % 10 == 0], TEMPLATE)
    vectors = np.array([r[4] for r in rows])
    want = {}
    for r in rows:
        if r[0] % 10 == 0:
            cosine = vectors @ np.array(r[4])
            best = max((round(c, 9), -o[0], o[2]) for c, o in zip(cosine, rows, strict=True) if o[0] != r[0])
            want[r[0]] = (-best[1], best[2], pytest.approx(best[0], abs=2e-6))
    got = {r.probe: (r.id, r.key, r.cosine) for r in apply("cosine_top1_cells", probes=probes, gallery=gallery).collect()}
    assert got == want
    spared = apply("search_pruning", probes=probes, gallery=gallery).first()
    assert spared.pairs == len(want) * len(rows) and (spared.left_out > 0.5 or scale)


def test_where_nothing_can_be_left_out_the_full_product_runs(spark):
    rows, gallery = crowd(spark, 200, 1, 1.0)
    probes = gallery.where("id % 10 = 0")
    assert apply("search_pruning", probes=probes, gallery=gallery).first().left_out == 0.0
    one = sorted(tuple(r) for r in apply("cosine_top1_cells", probes=probes, gallery=gallery).collect())
    assert one == sorted(tuple(r) for r in apply("cosine_top1", probes=probes, gallery=gallery).collect())
    assert apply("cosine_top1_cells", probes=probes.limit(0), gallery=gallery).count() == 0
    assert apply("cosine_top1_cells", probes=probes, gallery=gallery.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_the_review_queue_in_blocks(spark, monkeypatch, block):
    """Keys whose templates lie in several blocks, against all pairs."""
    from turnstile.operators import review

    monkeypatch.setattr(review, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        v = rng.normal(size=8) + 0.4
        look = None if i % 4 == 0 else (np.abs(rng.normal(size=6))).tolist()
        rows.append((i, 1, i % 40, 0, (v / np.linalg.norm(v)).tolist(), 90.0, look, False))
    apart = {(1, 2), (3, 9)}
    want = {}
    for x in rows:
        for y in rows:
            if x[2] < y[2]:
                cosine, like = want.get((x[2], y[2]), (-1.0, None))
                over = None if x[6] is None or y[6] is None else float(np.minimum(x[6], y[6]).sum())
                want[x[2], y[2]] = max(cosine, float(np.dot(x[4], y[4]))), over if like is None else like if over is None else max(like, over)
    k = Settings(review_floor=0.80, match_threshold=0.93, review_limit=50)
    band = {p: v for p, v in want.items() if 0.80 <= v[0] < 0.93 and p not in apart}
    order = sorted(band, key=lambda p: (band[p][1] is None, -round(band[p][1] or 0, 9), -round(band[p][0], 9), p))
    got = apply("review_queue", k, templates=spark.createDataFrame(rows, TEMPLATE), cannot_link=spark.createDataFrame(sorted(apart), "a long, b long")).orderBy("place").collect()
    assert [(r.key_a, r.key_b) for r in got] == order[:50] and len(order) > 60
    assert all(r.considered == len(order) and r.dropped == len(order) - 50 for r in got)
    assert all(abs(r.cosine - band[r.key_a, r.key_b][0]) < 1e-6 and abs(r.likeness - band[r.key_a, r.key_b][1]) < 1e-6 for r in got)
