import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratemill.streaming import intraday

ROWS = "day date, source string, benchmark string, value double, sampled_at timestamp, ok boolean, stale boolean"


def sample(day, source, value, minute=0):
    return dt.date(2024, 1, day), source, "official2", value, dt.datetime(2024, 1, day, 14, minute), True, False


def land(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def test_a_day_that_comes_in_two_batches_is_published_whole_and_once(spark, tmp_path):
    at = str(tmp_path)
    land(spark, f"{at}/in", [sample(1, "a", 10.0), sample(2, "a", 1.0)], [sample(1, "b", 20.0)])
    stream = intraday.samples(spark, f"{at}/in", spark.createDataFrame([], ROWS), 1)
    intraday.run(stream, intraday.keep_samples(f"{at}/kept"), f"{at}/state").awaitTermination()
    first = intraday.publish_closed(spark, f"{at}/kept", f"{at}/out", "2024-01-02").collect()
    assert [(r.day.day, r.n_sources, r.fix) for r in first] == [(1, 2, 15.0)]
    land(spark, f"{at}/in", [sample(1, "c", 99.0)])
    intraday.run(stream, intraday.keep_samples(f"{at}/kept"), f"{at}/state").awaitTermination()
    again = intraday.publish_closed(spark, f"{at}/kept", f"{at}/out", "2024-01-03").collect()
    assert sorted((r.day.day, r.fix) for r in again) == [(1, 15.0), (2, 1.0)]


def test_keyed_state_takes_the_latest_by_time_and_never_starts_anew(spark, tmp_path):
    at = str(tmp_path)
    each = intraday.upsert_table(f"{at}/table", ["source"], ["sampled_at"])
    batch = lambda *rows: spark.createDataFrame(rows, ROWS).select("source", "sampled_at", "value")
    each(batch(sample(1, "a", 1.0, 5), sample(1, "b", 2.0)), 0)
    each(batch(sample(1, "a", 9.0, 3), sample(1, "c", 3.0)), 1)
    each(batch(sample(1, "c", 4.0, 1)), 2)
    each(batch(sample(1, "c", 4.0, 1)), 2)  # a repeated batch
    assert sorted((r.source, r.value) for r in intraday.current(spark, f"{at}/table").collect()) == [("a", 1.0), ("b", 2.0), ("c", 4.0)]
    with pytest.raises(FileNotFoundError):
        each(batch(sample(1, "d", 1.0)), 9)


def test_closed_windows_leave_the_state(spark, tmp_path):
    at = str(tmp_path)
    land(spark, f"{at}/in", [sample(1, "a", 1.0, 0), sample(1, "b", 3.0, 10)], [sample(9, "a", 5.0)])
    stream = intraday.samples(spark, f"{at}/in", spark.createDataFrame([], ROWS), 1)
    counts = intraday.window_counts(stream, "1 day")
    q = counts.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(counts.schema).parquet(f"{at}/out").select(F.dayofmonth("window.start").alias("d"), "n", "mean").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2.0)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
