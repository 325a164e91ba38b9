"""Queries of extraction near places, and of summaries over channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratemill.functions import extraction
from ratemill.operators.quotes import once, spread
from ratemill.plans.registry import query, table

_IRAQ, _TEHRAN = ("Sulaymaniyah", "سلیمانیه"), ("Tehran", "تهران")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'pair' WHEN 1 THEN 'single' WHEN 2 THEN 'relative' END AS kind,
    CASE o_orderkey % 4 WHEN 0 THEN p + 50 WHEN 1 THEN p WHEN 2 THEN p + 250 END AS value FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 10) AS BIGINT) + 100000 AS DOUBLE) AS p FROM orders)""")
def x24_place_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    p = (F.col("o_totalprice") / 10).cast("bigint") + 100_000
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("Sulaymaniyah: "), p, F.lit(" / "), p + 100)).when(k == 1, F.concat(F.lit("سلیمانیه نقدی "), F.translate(p.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹"))).when(k == 2, F.concat(F.lit("Tehran "), p, F.lit("\nSulaymaniyah +250"))).otherwise("Sulaymaniyah closed")
    s = once(o.select("o_orderkey", said.alias("text")), s=extraction.signal(F.col("text"), _IRAQ, _TEHRAN))
    return s.select("o_orderkey", "s.kind", "s.value")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'Toman' ELSE '' END AS stated, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS mid, CASE WHEN l_linenumber IN (2, 3) THEN l_extendedprice * 10 WHEN l_linenumber = 4 THEN l_extendedprice END AS rial FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN stated = 'Toman' THEN 'toman' WHEN rial / mid BETWEEN 8 AND 12 THEN 'toman' WHEN rial / mid BETWEEN 0.8 AND 1.2 THEN 'rial' WHEN coalesce(rial, mid) >= 900000 THEN 'rial' WHEN coalesce(rial, mid) BETWEEN 50000 AND 400000 THEN 'toman' ELSE 'unknown' END AS unit FROM r""")
def y21_unit_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.col("l_linenumber"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("l_linenumber"), extraction.unit_by_ratio(F.when(n == 1, "Toman").otherwise(""), F.when(n != 2, v), F.when(n.isin(2, 3), v * 10).when(n == 4, v)).alias("unit"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE (l_quantity + l_tax) / 2 END AS midpoint, round(CASE WHEN l_linenumber = 3 THEN 7 ELSE (l_quantity * 10 + l_tax * 10) / 2 END, 6) AS midpoint_rial FROM lineitem""")
def y22_fill_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("l_linenumber"), F.lit(None).cast("double")
    f = extraction.filled_rial(F.col("l_quantity"), F.col("l_tax"), F.when(n % 2 == 0, F.col("l_extendedprice")), none, none, F.when(n == 3, 7.0), F.lit("toman"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f["midpoint"].alias("midpoint"), F.round(f["midpoint_rial"], 6).alias("midpoint_rial"))


@query("SELECT doc_id, count(*) AS n, max(length(w)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '.{0,40}idiot.{0,40}', 0, 's')) AS w FROM documents WHERE len(regexp_extract_all(lower(text), 'idiot')) = 1) GROUP BY 1")
def x21_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.regexp_count(F.lower("text"), F.lit("idiot")) == 1)
    w = d.select("doc_id", F.explode(extraction.windows(F.col("text"), "idiot")).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("w")).cast("long").alias("longest"))


@query("""SELECT c_custkey, round(greatest(0.01, 0.8 * greatest(0.45, least(1.05, 0.45 + (c_custkey % 101) / 150)) * greatest(0.45, least(1.05, 0.45 + (c_custkey % 97) / 160)) * greatest(0.5, least(1.1, 0.5 + (c_custkey % 89) / 140)) * greatest(0.45, least(1.1, 0.45 + (c_custkey % 83) / 150))
    * CASE c_custkey % 4 WHEN 0 THEN 1.08 WHEN 1 THEN 0.88 WHEN 2 THEN 0.62 ELSE 0.78 END * CASE WHEN c_custkey % 3 = 0 THEN 0.55 ELSE 1 END)::DOUBLE, 6) AS weight FROM customer""")
def a21b_research_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "direct").when(k % 4 == 1, "aggregated").when(k % 4 == 2, "reposted").otherwise("unclear")
    return table(spark, sf_dir, "customer").select("c_custkey", extraction.research_weight(F.lit(0.8), k % 101, k % 97, k % 89, k % 83, kind, F.when(k % 3 == 0, "exact").otherwise("none")).alias("weight"))


@query("WITH h AS (SELECT user_id, count(*) AS n, greatest(6.0, date_diff('second', min(ts), max(ts)) / 3600.0) AS span FROM events GROUP BY 1) SELECT CAST(round(CAST(sum(CASE WHEN n >= 2 THEN least(60.0, n / span * 24) ELSE least(40.0, n * 2.0) END) AS DOUBLE)) AS BIGINT) AS potential FROM h")
def a26_signal_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(6.0), seconds / 3600.0).alias("span"))
    return h.agg(F.round(F.sum(F.when(F.col("n") >= 2, F.least(F.lit(60.0), F.col("n") / F.col("span") * 24)).otherwise(F.least(F.lit(40.0), F.col("n") * 2.0)))).cast("bigint").alias("potential"))


@query("SELECT coalesce(quantile_cont(CAST(c_custkey % 31 AS DOUBLE), 0.5), 0) AS quotes_median, coalesce(quantile_cont(CAST(c_custkey % 13 AS DOUBLE), 0.5), 0) AS pairs_median FROM customer WHERE c_mktsegment = 'BUILDING'")
def a27_reference_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return ready.agg(F.coalesce(F.median(F.col("c_custkey") % 31), F.lit(0.0)).alias("quotes_median"), F.coalesce(F.median(F.col("c_custkey") % 13), F.lit(0.0)).alias("pairs_median"))


@query("SELECT c_nationkey, CASE max(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) WHEN 3 THEN 'Online' WHEN 2 THEN 'Degraded' WHEN 1 THEN 'Offline' ELSE 'Unknown' END AS status FROM customer WHERE c_custkey % 7 > 2 GROUP BY 1")
def a45_mirror_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    s = table(spark, sf_dir, "customer").where("c_custkey % 7 > 2").select("c_nationkey", F.when(k == 0, "Online").when(k == 1, "Degraded").when(k == 2, "Offline").otherwise("Unknown").alias("status"))
    worth = F.when(F.col("status") == "Online", 3).when(F.col("status") == "Degraded", 2).when(F.col("status") == "Offline", 1).otherwise(0)
    return s.groupBy("c_nationkey").agg(F.max_by("status", worth).alias("status"))


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 12 = 0 THEN 'P1' ELSE 'P2' END AS pr FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY s_acctbal DESC, s_suppkey) AS i, count_if(pr = 'P1') OVER () AS p1 FROM r),
    g AS (SELECT *, greatest(0, 10 - least(10, p1)) AS need FROM k) SELECT s_suppkey, CASE WHEN pr = 'P1' OR i <= need THEN 'P1' ELSE 'P2' END AS chosen FROM g WHERE (pr = 'P1' AND i <= 10) OR (pr = 'P2' AND i <= need + 10)""")
def w15_pilot_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of the first priority, filled up from the second, and ten more of the second."""
    r = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 12 == 0, "P1").otherwise("P2").alias("pr"))
    i = F.row_number().over(Window.partitionBy("pr").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    first = r.agg(F.greatest(F.lit(0), 10 - F.least(F.lit(10), F.count_if(F.col("pr") == "P1"))).alias("need"))
    g = r.withColumn("i", i).where("i <= 20").crossJoin(F.broadcast(first))
    return g.where("(pr = 'P1' AND i <= 10) OR (pr = 'P2' AND i <= need + 10)").select("s_suppkey", F.when((F.col("pr") == "P1") | (F.col("i") <= F.col("need")), "P1").otherwise("P2").alias("chosen"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_acctbal END AS open_market, CASE WHEN c_nationkey >= 6 THEN c_acctbal * CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 1 END END AS official FROM customer")
def f8_families_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    fam = F.array_compact(F.array(F.when(F.col("c_nationkey") < 12, "open_market"), F.when(F.col("c_nationkey") >= 6, "official")))
    v = F.create_map(F.lit("open_market"), "c_acctbal", F.lit("official"), "c_acctbal", F.lit("crypto_usdt"), "c_acctbal")
    fixed = extraction.legacy_units(F.when(F.col("c_custkey") % 2 == 0, "legacy").otherwise("other"), F.lit("unknown"), extraction.only_families(v, fam), ("official",))
    m = once(c, m=fixed)
    return m.select("c_custkey", F.try_element_at("m", F.lit("open_market")).alias("open_market"), F.try_element_at("m", F.lit("official")).alias("official"))
