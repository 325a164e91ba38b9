"""Queries of single rules that others use as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import extraction, labels, text, times
from ratemill.operators import quotes, robust
from ratemill.plans.registry import query, table
from ratemill.plans.rules import _SQL, cases

_c = F.col


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'rial' WHEN 1 THEN CASE WHEN c_custkey * 400 + 50 < 400000 THEN 'toman' ELSE 'rial' END ELSE 'unknown' END AS unit FROM customer")
def x8_unit_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("c_custkey")
    values = F.when(k % 3 == 1, F.array((k * 400).cast("bigint"), (k * 400 + 100).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "customer").select("c_custkey", extraction.unit_by_median(F.when(k % 3 == 0, "IRR").otherwise("x"), values).alias("unit"))


@query("SELECT event_id, CASE WHEN event_id % 25 < 24 THEN date_trunc('day', ts + INTERVAL 210 MINUTE) + INTERVAL (event_id % 25 * 60 + event_id % 60) MINUTE - CASE WHEN date_trunc('day', ts + INTERVAL 210 MINUTE) + INTERVAL (event_id % 25 * 60 + event_id % 60) MINUTE > ts + INTERVAL 930 MINUTE THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END - INTERVAL 210 MINUTE END AS utc FROM events")
def d3_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = times.local_time_of_day((_c("event_id") % 25).cast("int"), (_c("event_id") % 60).cast("int"), F.lit(210), _c("ts").cast("timestamp"))
    return e.select("event_id", at.cast("timestamp_ntz").alias("utc"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ['a', lower(c_mktsegment)] ELSE ['b', 'a'] END AS tokens FROM customer")
def x31_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(_c("c_custkey") % 2 == 0, F.concat(F.lit(" a |"), F.lower("c_mktsegment"), F.lit(",, a"))).otherwise("b,a|b|")
    return table(spark, sf_dir, "customer").select("c_custkey", text.tokens(said).alias("tokens"))


@query(f"WITH {_SQL} SELECT k, least(100, CASE WHEN is_named THEN 20 ELSE 0 END + CASE WHEN quotes > 0 THEN 10 ELSE 0 END + CASE WHEN is_phone AND is_address THEN 30 WHEN is_phone OR is_address THEN 14 ELSE 0 END + CASE WHEN quotes >= 2 THEN 12 ELSE 0 END + CASE WHEN quotes >= 4 THEN 6 ELSE 0 END + CASE WHEN is_mapped THEN 8 ELSE 0 END + CASE WHEN is_hint THEN 8 ELSE 0 END + CASE WHEN rate THEN 10 ELSE 0 END) AS structure, CASE WHEN k % 4 = 0 AND is_shop THEN 90 WHEN k % 4 = 0 THEN 82 WHEN k % 4 = 1 THEN 58 WHEN k % 4 = 2 THEN 34 ELSE 48 END AS directness FROM cases")
def c1_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the form of a quote, and for how direct it is (C2)."""
    one = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("direct", "aggregated", "reposted", "unclear")]), (_c("k") % 4 + 1).cast("int"))
    s = quotes.structure_points(F.contains(_c("said"), F.lit("rate")), one(_c("is_named")), _c("quotes"), F.when(_c("is_phone"), 1), F.when(_c("is_address"), 1), one(_c("is_mapped")), F.when(_c("is_hint"), "toman").otherwise("unknown"))
    return cases(spark, sf_dir).select("k", s.alias("structure"), quotes.directness_points(kind, _c("is_shop")).alias("directness"))


@query(f"WITH {_SQL} SELECT k, CASE WHEN quotes <= 1 THEN 'low_value' WHEN 1.0 - pairs / greatest(1, quotes) >= 0.6 AND quotes >= 5 THEN 'duplicate_heavy' WHEN parse < 40 AND quotes >= 3 THEN 'unstable_format' WHEN score >= 72 AND places >= 6 AND parse >= 58 THEN 'ready_for_research_ingestion' WHEN score >= 45 AND pairs >= 3 THEN 'monitor_only' WHEN rich = 0 AND linked = 0 THEN 'unstable_format' ELSE 'low_value' END AS status FROM cases")
def c4_channel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("k", labels.channel_status(_c("quotes"), _c("pairs"), _c("linked"), _c("parse"), _c("score"), _c("rich")).alias("status"))


@query("SELECT s_suppkey, round(CAST(0.9 * CASE s_suppkey % 3 WHEN 0 THEN 1.08 WHEN 1 THEN 0.98 ELSE 1.0 END * CASE WHEN s_suppkey % 4 = 0 THEN 1.0 ELSE greatest(0.7, 1 - least((s_suppkey % 50 + 1) / (1000 + (s_suppkey % 50 + 1) / 2.0), 0.08) * 2.5) END AS DOUBLE) + 1e-9, 6) AS weight FROM supplier")
def a13b_model_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("s_suppkey")
    kind = F.when(k % 3 == 0, "midpoint").when(k % 3 == 1, "reported_open_market").otherwise("x")
    w = robust.model_weight(F.lit(0.9), kind, F.when(k % 4 > 0, 1000.0), 1001.0 + k % 50)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(w + 1e-9, 6).alias("weight"))


@query(f"WITH {_SQL} SELECT k, CASE WHEN pairs < 2 THEN 'few' WHEN is_named THEN 'outliers' WHEN is_phone THEN 'dispersed' WHEN is_address THEN 'diagnostic' END AS kind FROM cases")
def y12_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which warning of a day comes first."""
    names = lambda c: F.when(c, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    w = labels.warning_text(_c("pairs"), names(_c("is_named")), F.when(_c("is_phone"), "high").otherwise("low"), names(_c("is_address")))
    kind = F.when(w.contains("fewer than two"), "few").when(w.contains("removed: a, b."), "outliers").when(w.contains("dispersed"), "dispersed").when(w.contains("Diagnostics-only"), "diagnostic")
    return cases(spark, sf_dir).select("k", kind.alias("kind"))
