"""Snapshots by manifest: whole versions, crashes, replays, races; requeued chunks."""

import os

import pytest

from turnstile.sources import sinks
from turnstile.sources.sinks import SnapshotConflict, manifest, prune_snapshots, read_snapshot, read_version, settle, upsert, upsert_batches, write_snapshot


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def values(spark, root, number=None):
    return {r.k: (r.v, r.x) for r in read_snapshot(spark, root, number).collect()}


def batch(spark, items):
    return spark.createDataFrame(items, "k long, v long, x string")


def files_under(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, root)
    old, new = batch(spark, [(1, 0, "a"), (2, 0, "b")]), batch(spark, [(2, 1, "c"), (3, 0, "d")])
    assert write_snapshot(old, root) == 1
    assert write_snapshot(upsert(read_snapshot(spark, root), new, ["k"], "v"), root) == 2
    assert rows(read_snapshot(spark, root)) == [(1, 0, "a"), (2, 1, "c"), (3, 0, "d")]
    assert rows(read_snapshot(spark, root, 1)) == [(1, 0, "a"), (2, 0, "b")]
    assert write_snapshot(old.limit(0), root) == 3 and read_snapshot(spark, root).count() == 0


def test_untouched_parts_stay_where_they_are(spark, tmp_path):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=8)
    write(batch(spark, [(k, 0, "a") for k in range(100)]), 0)
    before, first = files_under(root), manifest(spark, root)
    write(batch(spark, [(7, 1, "b")]), 1)
    second = manifest(spark, root)
    changed = {p for p in second.parts if second.parts[p] != first.parts.get(p)}
    assert len(changed) == 1 and set(first.parts) == set(second.parts)
    after = files_under(root)
    assert all(after[f] == t for f, t in before.items())  # none written again
    assert all(next(iter(changed)) in f for f in set(after) - set(before))
    got = values(spark, root)
    assert len(got) == 100 and got[7] == (1, "b") and got[8] == (0, "a")
    # Only the parts asked for are read.
    plan = read_version(spark, root, second, changed).inputFiles()
    assert plan and all(next(iter(changed)) in f for f in plan)


def test_crash_between_data_and_manifest(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=4)
    write(batch(spark, [(k, 0, "a") for k in range(20)]), 0)

    def dies(self, name, text):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks._Files, "publish", dies)
        with pytest.raises(RuntimeError):
            write(batch(spark, [(1, 1, "b"), (50, 1, "b")]), 1)
    assert values(spark, root) == {k: (0, "a") for k in range(20)}
    write(batch(spark, [(1, 1, "b"), (50, 1, "b")]), 1)  # the stream runs the batch again
    want = {k: (0, "a") for k in range(20)} | {1: (1, "b"), 50: (1, "b")}
    assert values(spark, root) == want and manifest(spark, root).number == 2
    # What the dead writer left goes once it is old; no version is hurt.
    prune_snapshots(spark, root, keep=2, grace=0)
    named = {f.split("/")[1] for n in (1, 2) for f in manifest(spark, root, n).parts.values()}
    assert set(os.listdir(f"{root}/data")) - {f for f in os.listdir(f"{root}/data") if f.startswith(".")} == named
    assert values(spark, root) == want and len(values(spark, root, 1)) == 20


def test_a_batch_counts_once(spark, tmp_path):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=4)
    write(batch(spark, [(1, 5, "a")]), 0)
    write(batch(spark, [(1, 5, "later in the same order")]), 1)
    write(batch(spark, [(1, 5, "a")]), 0)
    write(batch(spark, [(1, 5, "other")]), 1)
    assert values(spark, root) == {1: (5, "later in the same order")} and manifest(spark, root).number == 2
    other = upsert_batches(root, ["k"], "v", parts=4, writer="second")
    other(batch(spark, [(2, 0, "z")]), 0)
    assert values(spark, root) == {1: (5, "later in the same order"), 2: (0, "z")}


def test_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=2, keep=10)
    write(batch(spark, [(k, 0, "a") for k in range(10)]), 0)
    reader = read_snapshot(spark, root)
    write(batch(spark, [(k, 1, "b") for k in range(10)]), 1)
    assert {r.x for r in reader.collect()} == {"a"} and {r.x for r in read_snapshot(spark, root).collect()} == {"b"}


def test_races(spark, tmp_path):
    """Who publishes second begins again from the other's version; nothing is lost."""
    root = str(tmp_path / "t")
    first, second = upsert_batches(root, ["k"], "v", parts=2, writer="a"), upsert_batches(root, ["k"], "v", parts=2, writer="b")
    first(batch(spark, [(1, 0, "a")]), 0)
    base = manifest(spark, root)
    second(batch(spark, [(2, 0, "b")]), 0)
    with pytest.raises(SnapshotConflict):
        write_snapshot(batch(spark, [(3, 0, "c")]), root, base=base)
    real, raced = sinks.write_snapshot, []

    def slow(df, *args, **kwargs):
        if not raced:
            raced.append(1)
            second(batch(spark, [(4, 0, "d")]), 1)
        return real(df, *args, **kwargs)

    sinks.write_snapshot = slow
    try:
        first(batch(spark, [(5, 0, "e")]), 1)
    finally:
        sinks.write_snapshot = real
    assert {k: x for k, (_, x) in values(spark, root).items()} == {1: "a", 2: "b", 4: "d", 5: "e"}


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    write = upsert_batches(root, ["k"], "v", parts=2, keep=2)
    for n in range(7):
        write(batch(spark, [(n, n, str(n)), (0, n, str(n))]), n)
    assert len([f for f in os.listdir(f"{root}/_manifests") if f.endswith(".json") and not f.startswith(".")]) <= 3
    assert values(spark, root) == {0: (6, "6")} | {n: (n, str(n)) for n in range(1, 7)}


def test_stream_into_snapshots(spark, tmp_path):
    """A stream that dies after a publish and is started again leaves each row once."""
    root, source, state = str(tmp_path / "t"), str(tmp_path / "in"), str(tmp_path / "c")
    write = upsert_batches(root, ["k"], "v", parts=3)

    def run(fail_after):
        def sink(df, n):
            write(df, n)
            if n >= fail_after:
                raise RuntimeError("lost after the publish")

        stream = spark.readStream.schema("k long, v long, x string").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception:  # noqa: BLE001
            pass

    for n in range(3):
        batch(spark, [(n, n, "x"), (100, n, str(n))]).coalesce(1).write.mode("append").parquet(source)
    run(1)
    run(99)
    got = values(spark, root)
    assert {k for k in got} == {0, 1, 2, 100} and got[100] == (2, "2")
    assert manifest(spark, root).batches["stream"] == 2


def test_refused_chunks_come_back_until_taken(spark):
    queue = spark.createDataFrame([(1, s, 0) for s in range(7)], "run_id long, seq long, tries long")
    total = []
    for round_ in range(9):
        refuse = spark.createDataFrame([(1, 0, round_ == 8), (1, 1, round_ % 2 == 0)], "run_id long, chunk long, ok boolean")
        done, queue = settle(queue, refuse, ["seq"], chunk=3)
        total += [r.seq for r in done.collect()]
        queue = spark.createDataFrame([tuple(r) for r in queue.collect()], queue.schema)
    assert sorted(total) == list(range(7)) and queue.count() == 0
