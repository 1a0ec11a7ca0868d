import json

import pytest

from turnstile.catalog import apply
from turnstile.sources.readers import read_frames, read_manifest, read_zones

HEAD = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04\x03"


def test_frames_as_a_batch_and_as_a_stream(spark, tmp_path):
    for run, seq, data in (("a", 1, HEAD), ("a", 2, b"nothing"), ("b", 7, HEAD)):
        (tmp_path / "in" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / run / f"{seq}.jpg").write_bytes(data)
    want = [("a", 1, 0x0304, 0x0102), ("a", 2, None, None), ("b", 7, 0x0304, 0x0102)]
    assert sorted((r.run_id, r.seq, r.w, r.h) for r in read_frames(spark, str(tmp_path / "in")).collect()) == want
    frames = read_frames(spark, str(tmp_path / "in"), stream=True, per_batch=2)
    q = frames.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90), "the stream did not end"
    finally:
        q.stop()
    assert sorted((r.run_id, r.seq, r.w, r.h) for r in spark.table("frames").collect()) == want


def test_a_manifest_is_read_and_judged(spark, tmp_path):
    clips = [
        {"label": "a", "path": "/a.mp4", "actualUnique": 3, "tags": ["surge"]},
        {"label": "b", "path": "b.mp4", "actualUnique": 3, "tags": []},
        {"label": "c", "path": "/c.mp4", "actualUnique": 0},
        {"label": "d", "path": "/d.mp4", "actualUnique": 1, "tags": ["serge"]},
        {"label": "e", "path": "/e.mp4", "actualUnique": 1},
        {"label": "e", "path": "/f.mp4", "actualUnique": 1},
    ]
    (tmp_path / "m.json").write_text(json.dumps({"clips": clips}, indent=1))
    found = {r.clip: r.fault for r in apply("manifest_validate", manifest=read_manifest(spark, str(tmp_path / "m.json"))).collect()}
    assert found == {0: None, 1: "path", 2: "actual", 3: "tags", 4: "label", 5: "label"}


def test_a_manifest_of_another_version_is_an_error(spark, tmp_path):
    clip = {"label": "a", "path": "/a.mp4", "actualUnique": 3, "tags": []}
    for version, ok in ((1, True), (2, False), ("x", False)):
        (tmp_path / f"{version}.json").write_text(json.dumps({"version": version, "clips": [clip]}))
        manifest = read_manifest(spark, str(tmp_path / f"{version}.json"))
        if ok:
            assert manifest.count() == 1 and manifest.first().label == "a"
        else:
            with pytest.raises(Exception, match="version not supported"):
                manifest.collect()


def test_zones_from_json(spark, tmp_path):
    (tmp_path / "z.json").write_text('{"label": "door", "points": [[0, 0], [4, 0], [4, 4], [0, 4]]}\n{"label": "till", "mode": "detections", "points": [[9, 9], [12, 9], [12, 12]]}\n')
    corners = read_zones(spark, str(tmp_path / "z.json"))
    boxes = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 5.0, 2.0)], "frame long, n long, x double, y double")
    assert [(r.n, r.label) for r in apply("point_in_polygon", boxes=boxes, corners=corners).collect()] == [(1, "door")]
    assert {r.label: r.valid for r in apply("zone_corners", corners=corners).collect()} == {"door": True, "till": True}


def test_images_are_left_out_of_the_scan_unless_asked_for(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.jpg").write_bytes(HEAD)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    frames = read_frames(spark, str(tmp_path / "in"))
    assert "content" not in plan(frames.select("run_id", "seq")) and "content" in plan(frames.select("image"))
