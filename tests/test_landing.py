import json

from pyspark.sql import functions as F

from ratemill.sources import landing


def put(path, value):
    path.write_text(json.dumps(value))


def test_files(spark, tmp_path):
    fixes = tmp_path / "fix"
    fixes.mkdir()
    body = {"date": "2024-01-01", "benchmarks": {"official": {"fix": 5.0, "band": {"p25": 4.0, "p75": 6.0}, "available": True, "withheld": False, "status": "Green", "source_medians": {"a": 5.0}}}}
    put(fixes / "2024-01-01.json", body)
    (fixes / "notes.json").write_text("{}")
    (fixes / "2024-01-02.json").write_text("{broken")
    rows = landing.fix_rows(landing.daily_fixes(spark, str(fixes))).collect()
    assert [(str(r.day), r.benchmark, r.fix, r.p25, r.withheld) for r in rows] == [("2024-01-01", "official", 5.0, 4.0, False)]

    tries = tmp_path / "intraday"
    tries.mkdir()
    sample = {"sampled_at": "2024-01-01T13:45:00Z", "benchmarks": {"official": 5.0, "open_market": 6.0}, "ok": True}
    put(tries / "a.json", {"date": "2024-01-01", "collected_at": "2024-01-01T13:45:00Z", "sources": {"old": {"sample": sample}}})
    got = landing.samples(landing.attempts(spark, str(tries)), {"old": "new"}).collect()
    assert sorted((r.source, r.benchmark, r.value, r.ok, r.stale) for r in got) == [("new", "official", 5.0, True, False), ("new", "open_market", 6.0, True, False)]

    series = tmp_path / "series.json"
    put(series, {"rows": [{"date": "2024-01-01", "fix": "1,000", "withheld": "true"}, {"date": "2024-01-02", "fix": -1, "status": "Red", "withheld": False}, {"date": "soon"}]})
    assert [(str(r.day), r.fix, r.withheld) for r in landing.series_rows(spark, str(series)).orderBy("day").collect()] == [("2024-01-01", 1000.0, True), ("2024-01-02", None, False)]
    flat = tmp_path / "flat.json"
    put(flat, [{"date": "2024-01-01", "value": "5"}, {"date": "x", "value": "6"}, {"date": "2024-01-02", "value": "-6"}])
    assert [(str(r.day), r.value) for r in landing.value_series(spark, str(flat)).collect()] == [("2024-01-01", 5.0)]


def test_payload_and_redaction(spark):
    r = spark.range(1).select(
        landing.payload(F.lit('{"a": 1}')).alias("a"), landing.payload(F.lit('var lastrates = {"b": 2}; var yesterday = {"c": 3};')).alias("b"), landing.payload(F.lit("nothing")).alias("c"), landing.redact(F.lit("https://x.com/?api_key=abc&z=1")).alias("d")
    ).first()
    assert (r.a, r.b, r.c, r.d) == ('{"a": 1}', '{"c": 3}', None, "https://x.com/?api_key=***&z=1")


def test_days_are_written_once(spark, tmp_path):
    df = spark.range(3)
    assert landing.write_once(df, str(tmp_path / "d"), "2024-01-01")
    assert not landing.write_once(df, str(tmp_path / "d"), "2024-01-01")
    landing.write_csv(df, str(tmp_path / "c"), ["id"])
    assert landing.csv_strings(spark, str(tmp_path / "c")).dtypes == [("id", "string")]
