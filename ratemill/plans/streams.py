"""Queries that run a stream over the tables to its present end and give what it left."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.plans.registry import query
from ratemill.session import remove, shared_folder
from ratemill.sources import samples as src
from ratemill.sources.samples import EVENT_SAMPLES_SQL
from ratemill.streaming import intraday


def _landed(spark: SparkSession, sf_dir: str, parts: int, last: str | None = None) -> tuple[DataFrame, str]:
    """A stream of events as samples, one file a batch; last: a time at which one more sample, of no benchmark, lands in the end."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    s = src.event_samples(spark, sf_dir).withColumns({c: F.col(c).cast("timestamp") for c in ("sampled_at", "quote_time")})
    s.repartition(parts, "event_id").write.parquet(f"{at}/in")
    if last:
        s.limit(1).withColumns({"sampled_at": F.lit(last).cast("timestamp"), "benchmark": F.lit(None).cast("string")}).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return intraday.samples(spark, f"{at}/in", s, 1), at


@query(f"""WITH {EVENT_SAMPLES_SQL} SELECT time_bucket(INTERVAL 30 MINUTE, sampled_at, TIMESTAMP '2024-01-01 00:15:00') AS start, benchmark, count(*) AS n, round(avg(value), 6) AS mean FROM samples GROUP BY 1, 2""")
def t2_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as the watermark closes them; a last sample, long after all others, closes them all."""
    stream, at = _landed(spark, sf_dir, 4, "2025-01-01")
    counts = intraday.window_counts(stream, "60 days")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{at}/out").where("benchmark IS NOT NULL").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "benchmark", "n", F.round("mean", 6).alias("mean"))


@query(f"WITH {EVENT_SAMPLES_SQL} SELECT event_id, benchmark, stale OR NOT (hour(sampled_at) * 60 + minute(sampled_at) BETWEEN 825 AND 855) AS stale FROM samples")
def t3_late_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, at = _landed(spark, sf_dir, 2)
    out = f"{at}/out"
    intraday.flagged(stream).select("event_id", "benchmark", "stale").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {EVENT_SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, benchmark ORDER BY sampled_at DESC, value DESC) AS k FROM samples) SELECT source, benchmark, sampled_at, value FROM r WHERE k = 1")
def t6_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sample of each source and benchmark, kept over four batches that don't come in the order of their times."""
    stream, at = _landed(spark, sf_dir, 4)
    each = intraday.upsert_table(f"{at}/table", ["source", "benchmark"], ["sampled_at", "value"])
    intraday.run(stream.select("source", "benchmark", "sampled_at", "value"), each, f"{at}/state").awaitTermination()
    return intraday.current(spark, f"{at}/table").select("source", "benchmark", F.col("sampled_at").cast("timestamp_ntz").alias("sampled_at"), "value")


@query(f"""WITH {EVENT_SAMPLES_SQL}, m AS (SELECT day, benchmark, source, quantile_cont(CAST(value AS DOUBLE), 0.5) AS m FROM samples WHERE benchmark <> 'official' AND value > 0 AND (benchmark <> 'open_market' OR (ok AND NOT stale)) AND day < DATE '2024-01-20' GROUP BY 1, 2, 3)
    SELECT day, benchmark, count(*) AS n_sources, round(quantile_cont(m, 0.5), 6) AS fix FROM m GROUP BY 1, 2""")
def t4_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days published once from samples that came in four batches; a second run with other samples of them changes nothing."""
    stream, at = _landed(spark, sf_dir, 4)
    intraday.run(stream, intraday.keep_samples(f"{at}/kept"), f"{at}/state").awaitTermination()
    intraday.publish_closed(spark, f"{at}/kept", f"{at}/out", "2024-01-20")
    late = spark.read.parquet(f"{at}/in").withColumn("value", F.col("value") * 7)
    late.write.mode("append").parquet(f"{at}/in")
    intraday.run(stream, intraday.keep_samples(f"{at}/kept"), f"{at}/state").awaitTermination()
    out = intraday.publish_closed(spark, f"{at}/kept", f"{at}/out", "2024-01-20")
    return out.select("day", "benchmark", "n_sources", F.round("fix", 6).alias("fix"))
