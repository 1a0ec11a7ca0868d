"""Operators on tables of a user's own, with answers worked out by hand."""

import pytest

from turnstile.catalog import apply
from turnstile.settings import Settings

BOX = "frame long, n long, x double, y double, w double, h double, conf double, excluded boolean"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nms_keeps_the_best_of_what_overlaps(spark):
    boxes = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.6, False), (1, 2, 1.0, 0.0, 10.0, 10.0, 0.9, False), (1, 3, 50.0, 50.0, 10.0, 10.0, 0.3, False), (2, 1, 0.0, 0.0, 10.0, 10.0, 0.5, False)], BOX
    )
    assert rows(apply("nms", boxes=boxes)) == [(1, 2), (1, 3), (2, 1)]
    assert rows(apply("nms", Settings(nms_iou=0.95), boxes=boxes)) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert rows(apply("dedupe_boxes", boxes=boxes)) == [(1, 1), (1, 3), (2, 1)]  # the first of the input stays
    assert rows(apply("iou_pairs", boxes=boxes)) == [(1, 1, 2, pytest.approx(90 / 110, abs=1e-6))]


def test_search_region_takes_raw_boxes_before_tracks(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.6, False)], BOX)
    tracks = spark.createDataFrame([(1, 7, 0.5, 0.0, 10.0, 10.0), (1, 8, 90.0, 0.0, 10.0, 10.0)], "frame long, n long, x double, y double, w double, h double")
    assert rows(apply("search_region", boxes=boxes, tracks=tracks)) == [(1, 1, False), (1, 8, True)]


def test_default_score_threshold_includes_equality(spark):
    predictions = spark.createDataFrame([(1, 1, 0.6, 0.5), (1, 2, 0.6, 0.49)], "frame long, n long, obj double, cls double")
    assert rows(apply("score_filter", predictions=predictions)) == [(1, 1, 0.3)]


def test_points_on_either_side_of_a_concave_zone(spark):
    zone = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    corners = spark.createDataFrame([("hall", 1, "faces", i, float(x), float(y)) for i, (x, y) in enumerate(zone, 1)], "label string, zn long, mode string, i long, x double, y double")
    boxes = spark.createDataFrame([(1, 1, 5.0, 2.0, 1.0, 1.0, 1.0, False), (1, 2, 5.0, 8.0, 1.0, 1.0, 1.0, False), (1, 3, 1.0, 8.0, 1.0, 1.0, 1.0, False)], BOX)
    assert rows(apply("point_in_polygon", boxes=boxes, corners=corners)) == [(1, 1, "hall"), (1, 3, "hall")]
    assert rows(apply("zone_corners", corners=corners)) == [("hall", 5, True)]


def test_the_gate_counts_absence_and_rejects_by_the_first_floor(spark):
    faces = spark.createDataFrame(
        [(1, 1, 80.0, 30.0, 0.9, None), (1, 2, 55.0, 30.0, 0.9, None), (1, 3, 80.0, 5.0, 0.1, 9.0), (1, 4, 80.0, None, 0.9, 9.0)],
        "frame long, n long, width_px double, ied double, frontality double, sharpness double",
    )
    assert rows(apply("quality_gate", faces=faces)) == [(1, 1, None, True, False), (1, 2, "width", False, False), (1, 3, None, True, False), (1, 4, None, True, False)]
    armed = Settings(ied_floor=10.0, frontality_floor=0.5)
    assert rows(apply("quality_gate", armed, faces=faces)) == [(1, 1, None, True, False), (1, 2, "width", False, False), (1, 3, "ied", False, False), (1, 4, None, True, True)]


def unit(*parts):
    v = [0.0] * 8
    for i, x in parts:
        v[i] = x
    return v


TEMPLATE = "id long, run_id long, key long, label long, vec array<double>, quality double, appearance array<double>, staff boolean"


def test_verdicts_at_the_threshold_and_staff_first(spark):
    row = lambda i, key, v, staff=False: (i, 1, key, 0, v, 90.0, None, staff)
    gallery = spark.createDataFrame([row(1, 10, unit((0, 1.0))), row(2, 20, unit((1, 1.0)), True)], TEMPLATE)
    at = (0.363, (1 - 0.363**2) ** 0.5)
    probes = spark.createDataFrame([row(100, -1, unit((0, at[0]), (5, at[1]))), row(101, -2, unit((0, 0.3), (6, 0.954))), row(102, -3, unit((0, 0.6), (1, 0.8)))], TEMPLATE)
    got = {r.probe: (r.verdict, r.key) for r in apply("match_verdict", probes=probes, gallery=gallery).collect()}
    assert got == {100: ("match", 10), 101: ("mint", None), 102: ("staff", None)}


def test_mints_are_numbered_by_run_and_merges_refused(spark):
    acts = spark.createDataFrame([(1, 5, 1, 10, True), (1, 6, 2, 20, True), (2, 7, 3, 5, True), (1, 5, 4, 30, False)], "run_id long, track long, event_id long, us long, minted boolean")
    assert [(r.run_id, r.event_id, r.key) for r in apply("mint_keys", acts=acts).orderBy("run_id", "event_id").collect()] == [(1, 1, "p00001"), (1, 2, "p00002"), (2, 3, "p00001")]
    t = [(i, 1, key, 0, unit((0, 1.0)), 90.0, None, False) for i, key in ((1, 1), (2, 2), (3, 2), (4, 3), (5, 4))]
    templates = spark.createDataFrame(t, TEMPLATE)
    apart = spark.createDataFrame([(1, 3)], "a long, b long")
    merges = spark.createDataFrame([(1, 2, True), (1, 3, False), (1, 9, False), (4, 4, False), (1, 4, True)], "keep long, gone long, only_singleton boolean")
    assert rows(apply("merge_apply", templates=templates, cannot_link=apart, merges=merges)) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 1)]
    assert rows(apply("merge_refused", templates=templates, cannot_link=apart, merges=merges)) == [(1, 2, "not-singleton"), (1, 3, "cannot-link"), (1, 9, "unknown-key"), (4, 4, "same-key")]
    assert rows(apply("cannot_link_norm", templates=templates, cannot_link=apart, merges=merges)) == [(1, 3)]


def test_default_clocks_are_seconds(spark):
    seen = spark.createDataFrame([(1, i, int(s * 1e6)) for i, s in enumerate((0, 3, 8.5, 20))], "track long, event_id long, us long")
    assert rows(apply("staff_crossings", sightings=seen)) == [(1, 4, 3)]


def test_checks_use_the_envelope_and_the_low_rate(spark):
    run = "clip long, half long, frames long, result_frames long, person_boxes long, faces long, passing long, embed_row boolean, embeds long, matches long, uniq long, end_reason string, face_width double, ingest_fps double, count_fps double"
    runs = spark.createDataFrame(
        [(1, 0, 0, 100, 50, 100, 9, True, None, 9, 10, "source-ended", 80.0, 4.0, 2.0), (2, 0, 100, 100, 50, 100, 50, False, 50, 50, 12, "source-ended", 50.0, 4.0, 2.0)], run
    )
    clips = spark.createDataFrame([(1, "/a", 10, ["surge"]), (2, "/b", 10, ["veil"])], "clip long, path string, actual long, tags array<string>")
    failed = {(r.clip, r.name) for r in apply("eval_checks", runs=runs, clips=clips).where("NOT passed").collect()}
    assert failed == {(1, "gate-pass-rate"), (2, "embed-ran"), (2, "unique-count-error"), (2, "face-size-vs-floor")}
    assert {r.clip: (r.frames, r.embeds) for r in apply("funnel", runs=runs).collect()} == {1: (100, None), 2: (100, 0)}


def test_a_table_that_was_not_given_is_an_error(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.6, False)], BOX)
    with pytest.raises(ValueError):
        apply("face_track_assoc", faces=boxes)
    with pytest.raises(ValueError):
        apply("nms")
