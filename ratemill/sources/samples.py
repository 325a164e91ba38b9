"""Stand-ins for the domain's inputs over the test tables: samples, messages, basket records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = {"view": "open_market", "click": "official", "purchase": "regional_transfer", "signup": "crypto_usdt", "error": "emami_gold_coin"}


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: six sources, one benchmark per type, quotes k / 2 hours old; k from props spoils some."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return e.select(
        F.col("event_id"), F.to_date("ts").alias("day"), F.concat(F.lit("s"), F.col("user_id") % 6).alias("source"), kind.alias("benchmark"), F.col("value"), F.col("ts").alias("sampled_at"),
        F.when(k % 4 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), k * 60)).alias("quote_time"), (k < 95).alias("ok"), (k >= 90).alias("stale"),
    )


EVENT_SAMPLES_SQL = """samples AS (
    SELECT event_id, CAST(ts AS DATE) AS day, concat('s', CAST(user_id % 6 AS VARCHAR)) AS source,
           CASE event_type WHEN 'view' THEN 'open_market' WHEN 'click' THEN 'official' WHEN 'purchase' THEN 'regional_transfer' WHEN 'signup' THEN 'crypto_usdt' WHEN 'error' THEN 'emami_gold_coin' END AS benchmark,
           value, ts AS sampled_at,
           CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 <> 0 THEN ts - to_minutes(CAST(json_extract_string(props, '$.k') AS INTEGER) * 60) END AS quote_time,
           CAST(json_extract_string(props, '$.k') AS INTEGER) < 95 AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 AS stale
    FROM events)"""


def trade_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples that are close enough to be published: a day per year, benchmarks by line status and flag, sources by supplier."""
    t = _table(spark, sf_dir, "lineitem")
    bench = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "open_market").otherwise("crypto_usdt")).when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "regional_transfer").otherwise("emami_gold_coin")).otherwise("official")
    return t.select(
        F.to_date(F.date_trunc("year", "l_shipdate")).alias("day"), F.concat(F.lit("s"), F.col("l_suppkey") % 6).alias("source"), bench.alias("benchmark"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("sampled_at"),
        F.lit(None).cast("timestamp").alias("quote_time"), (F.col("l_discount") < 0.1).alias("ok"), (F.col("l_tax") > 0.078).alias("stale"),
    )


TRADE_SAMPLES_SQL = """samples AS (
    SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS day, concat('s', CAST(l_suppkey % 6 AS VARCHAR)) AS source,
           CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'open_market' ELSE 'crypto_usdt' END WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'regional_transfer' ELSE 'emami_gold_coin' END ELSE 'official' END AS benchmark,
           l_extendedprice AS value, l_shipdate AS sampled_at, CAST(NULL AS TIMESTAMP) AS quote_time, l_discount < 0.1 AS ok, l_tax > 0.078 AS stale
    FROM lineitem)"""


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value per day and key: orders by day and priority."""
    return _table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("key")).agg(F.round(F.avg("o_totalprice"), 4).alias("fix"))


DAILY_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS key, round(avg(o_totalprice), 4) AS fix FROM orders GROUP BY 1, 2)"""


def basket_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as records of baskets: a basket per nation, ten handles, quality and so on from the keys."""
    c = _table(spark, sf_dir, "customer")
    cat = F.element_at(F.array(*[F.lit(x) for x in ("direct_shop", "settlement_exchange", "market_channel", "aggregator", "unknown")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select(
        F.col("c_nationkey").cast("string").alias("basket"), F.concat(F.lit("h"), F.col("c_custkey") % 10).alias("handle"), (F.col("c_acctbal") + 1_450_000).alias("rate"), cat.alias("category"),
        (F.col("c_custkey") % 71 + 40).cast("double").alias("quality"), (F.col("c_custkey") % 83 + 18).cast("double").alias("freshness"), (F.col("c_custkey") % 61 + 30).cast("double").alias("directness"), (F.col("c_custkey") % 91).cast("double").alias("readiness"),
    )


BASKET_SQL = """records AS (
    SELECT CAST(c_nationkey AS VARCHAR) AS basket, concat('h', CAST(c_custkey % 10 AS VARCHAR)) AS handle, c_acctbal + 1450000 AS rate,
           CASE c_custkey % 5 WHEN 0 THEN 'direct_shop' WHEN 1 THEN 'settlement_exchange' WHEN 2 THEN 'market_channel' WHEN 3 THEN 'aggregator' ELSE 'unknown' END AS category,
           CAST(c_custkey % 71 + 40 AS DOUBLE) AS quality, CAST(c_custkey % 83 + 18 AS DOUBLE) AS freshness, CAST(c_custkey % 61 + 30 AS DOUBLE) AS directness, CAST(c_custkey % 91 AS DOUBLE) AS readiness
    FROM customer)"""

CATEGORY_WEIGHT = dict(aggregator=0.55, direct_shop=1.00, market_channel=0.68, regional_market_channel=0.82, settlement_exchange=0.88, unknown=0.50)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages of channels."""
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("handle"), (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_index"), F.col("role"), F.col("text"))


MESSAGES_SQL = """messages AS (SELECT conv_id % 40 AS handle, conv_id * 1000 + turn AS msg_index, role, text FROM conversations)"""
