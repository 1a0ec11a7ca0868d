import json

import duckdb

from turnstile import catalog
from turnstile.operators import reports
from turnstile.plans.dialect import DUCKDB, Dialect

SF = "/root/testdata/sf0.001"


def test_payloads_are_json_within_budget(spark):
    for r in catalog.queries()["tap_payload"](spark, SF).limit(50).collect():
        body = json.loads(r.payload)
        assert r.bytes == len(r.payload.encode()) <= reports.BUDGET and len(body["rows"]) <= 4
        assert [x["n"] for x in body["rows"]] == sorted(x["n"] for x in body["rows"])


def test_critical_clips_come_first(spark, tmp_path):
    rows = sorted((r for r in catalog.queries()["clip_report"](spark, SF).collect() if r.half == 0), key=lambda r: r.rank)
    flags = [r.line.startswith("CRITICAL") for r in rows]
    assert flags == sorted(flags, reverse=True) and any(flags)
    reports.write_results(spark.createDataFrame([(0, "a"), (1, "b")], "half int, clip string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert [reports.exit_code(v) for v in ("improvement", "neutral", "regression", "inconclusive")] == [0, 0, 2, 3]


def test_percents_are_written_as_c_does(spark):
    """Halves that a binary number holds a little above or below go there, and exact ones to the even digit."""
    values = [k / 200 for k in range(-500, 20_500)] + [k / 20_000 for k in range(-300, 700)] + [-1e-7, 123456.785, -99999.995, 0.00495, 2.00005]
    spark.createDataFrame([(x,) for x in [*values, None]], "x double").createOrReplaceTempView("percents")
    got = [r[0] for r in spark.sql(f"SELECT {Dialect(spark=True).percent('x')} AS p FROM percents").collect()]
    with duckdb.connect() as db:
        want = [db.execute(f"SELECT {DUCKDB.percent('?::DOUBLE')}", [x, x]).fetchone()[0] for x in [*values, None]]
    assert got == want
