"""Queries of the fix, its history and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratemill.functions import labels, stats, times
from ratemill.operators import asof, dedup, fix, robust
from ratemill.plans.registry import query, table
from ratemill.sources import samples as src
from ratemill.sources.samples import BASKET_SQL, CATEGORY_WEIGHT, DAILY_SQL, EVENT_SAMPLES_SQL, TRADE_SAMPLES_SQL

Q = "quantile_cont(CAST({} AS DOUBLE), {})"


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


_MEDIANS = """medians AS (
    SELECT day, benchmark, source, quantile_cont(CAST(CASE WHEN benchmark <> 'open_market' OR (ok AND NOT stale) THEN CASE WHEN value > 0 THEN value END END AS DOUBLE), 0.5) AS m, bool_or(stale) AS any_stale
    FROM samples GROUP BY 1, 2, 3 HAVING m IS NOT NULL)"""
_BANDS = """bands AS (
    SELECT day, benchmark, count(*) AS n_sources, quantile_cont(m, 0.5) AS fix, quantile_cont(m, 0.25) AS p25, quantile_cont(m, 0.75) AS p75,
           bool_or(any_stale AND benchmark IN ('regional_transfer', 'crypto_usdt', 'emami_gold_coin')) AS spoiled
    FROM medians WHERE benchmark <> 'official' GROUP BY 1, 2),
fixed AS (
    SELECT day, benchmark, n_sources, fix, p25, p75, (p75 - p25) / nullif(fix, 0) AS dispersion, coalesce((p75 - p25) / nullif(fix, 0), 0) > 0.05 OR spoiled AS withheld FROM bands)"""
_STATUS = "CASE WHEN withheld OR dispersion IS NULL THEN 'WITHHOLD' WHEN dispersion <= 0.015 THEN 'Green' WHEN dispersion <= 0.035 THEN 'Amber' WHEN dispersion <= 0.05 THEN 'Red' ELSE 'WITHHOLD' END"
_FIX_OUT = f"SELECT day, benchmark, n_sources, round(fix, 6) AS fix, round(p25, 6) AS p25, round(p75, 6) AS p75, round(dispersion, 6) AS dispersion, {_STATUS} AS status, withheld, NOT withheld AS available FROM fixed"


@query(f"WITH {TRADE_SAMPLES_SQL}, {_MEDIANS}, {_BANDS} {_FIX_OUT}")
def a1_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fix.fixes(src.trade_samples(spark, sf_dir)), fix=6, p25=6, p75=6, dispersion=6)


@query(f"WITH {EVENT_SAMPLES_SQL}, {_MEDIANS}, {_BANDS} {_FIX_OUT}")
def a2_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(fix.fixes(src.event_samples(spark, sf_dir)), fix=6, p25=6, p75=6, dispersion=6)


@query("SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(value AS DOUBLE), 0.9), 6) AS p90 FROM events GROUP BY 1")
def a3_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(stats.percentile(v, 0.25), 6).alias("p25"), F.round(stats.percentile(v, 0.9), 6).alias("p90"))


@query("SELECT o_orderpriority, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5), 6) AS med FROM orders GROUP BY 1")
def a4_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(stats.median(F.col("o_totalprice")), 6).alias("med"))


@query(f"WITH {EVENT_SAMPLES_SQL} SELECT day, benchmark, source, greatest(count(DISTINCT quote_time), max(CASE WHEN value > 0 THEN 1 ELSE 0 END)) AS cadence FROM samples WHERE value > 0 GROUP BY 1, 2, 3")
def a5_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_samples(spark, sf_dir).where("value > 0").groupBy("day", "benchmark", "source").agg(fix.cadence().alias("cadence"))


@query(f"""WITH {EVENT_SAMPLES_SQL}, r AS (
    SELECT *, coalesce(quote_time, sampled_at) AS effective_time, row_number() OVER (PARTITION BY day, benchmark, source ORDER BY coalesce(quote_time, sampled_at) DESC, sampled_at DESC, value DESC) AS k FROM samples WHERE value > 0)
    SELECT day, benchmark, source, value, effective_time, sampled_at FROM r WHERE k = 1""")
def a6_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix.latest(src.event_samples(spark, sf_dir)).drop("cadence")


@query(f"""WITH {TRADE_SAMPLES_SQL}, {_MEDIANS}, {_BANDS},
    off AS (SELECT day, quantile_cont(m, 0.5) AS fix FROM medians WHERE benchmark = 'official' GROUP BY 1),
    w AS (SELECT day, max(CASE WHEN benchmark = 'open_market' AND NOT withheld THEN fix END) AS s, max(CASE WHEN benchmark = 'regional_transfer' AND NOT withheld THEN fix END) AS t,
                 max(CASE WHEN benchmark = 'crypto_usdt' AND NOT withheld THEN fix END) AS c, max(CASE WHEN benchmark = 'emami_gold_coin' AND NOT withheld THEN fix END) / 705 AS g FROM fixed GROUP BY 1)
    SELECT w.day, round((s - off.fix) / off.fix * 100, 4) AS street_official_gap_pct, round((s - t) / t * 100, 4) AS street_transfer_gap_pct, round((c - s) / s * 100, 4) AS street_crypto_gap_pct, round((g - s) / s * 100, 4) AS street_gold_gap_pct
    FROM w JOIN off USING (day)""")
def a7_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.trade_samples(spark, sf_dir)
    off = fix.source_medians(s.where("benchmark = 'official'")).groupBy("day").agg(stats.median(F.col("m")).alias("official"))
    wide = fix.widen(fix.fixes(s)).drop("official").join(off, "day")
    return _r(fix.gaps(wide), street_official_gap_pct=4, street_transfer_gap_pct=4, street_crypto_gap_pct=4, street_gold_gap_pct=4)


_LATEST = """r AS (
    SELECT *, coalesce(quote_time, sampled_at) AS et, row_number() OVER (PARTITION BY day, source ORDER BY coalesce(quote_time, sampled_at) DESC, sampled_at DESC, value DESC) AS k,
           row_number() OVER (PARTITION BY day, source, fresh ORDER BY coalesce(quote_time, sampled_at) DESC, sampled_at DESC, value DESC) AS kf FROM o)"""


def _official_sql(hours: int) -> str:
    return f"""WITH {EVENT_SAMPLES_SQL}, o AS (SELECT *, quote_time IS NOT NULL AND sampled_at - quote_time <= INTERVAL {hours} HOUR AS fresh FROM samples WHERE benchmark = 'official' AND value > 0), {_LATEST},
    cf AS (SELECT day, source, greatest(count(DISTINCT quote_time), 1) AS cadence FROM o WHERE fresh GROUP BY 1, 2), ca AS (SELECT day, source, greatest(count(DISTINCT quote_time), 1) AS cadence FROM o GROUP BY 1, 2),
    f AS (SELECT day, source, value, et, cadence, FALSE AS is_stale FROM r JOIN cf USING (day, source) WHERE fresh AND kf = 1),
    a AS (SELECT day, source, value, et, cadence, TRUE AS is_stale FROM r JOIN ca USING (day, source) WHERE k = 1 AND sampled_at - et <= INTERVAL 1080 HOUR),
    b AS (SELECT * FROM f UNION ALL SELECT * FROM a WHERE (day, source) NOT IN (SELECT (day, source) FROM f)),
    t AS (SELECT *, max(et) OVER (PARTITION BY day) AS top FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY day) AS n_freshest, max(cadence) OVER (PARTITION BY day) AS most FROM t WHERE et = top),
    p AS (SELECT day, n_freshest, quantile_cont(CAST(value AS DOUBLE), 0.5) AS fix, quantile_cont(CAST(value AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(value AS DOUBLE), 0.75) AS p75, string_agg(source, ',' ORDER BY source) AS selected_sources, max(et) AS selected_quote_time, count(*) AS n, bool_or(is_stale) AS using_stale_fallback FROM n WHERE cadence = most GROUP BY 1, 2)
    SELECT day, round(fix, 6) AS fix, selected_sources, selected_quote_time, CASE WHEN n < n_freshest THEN 'freshest_quote_time_then_update_cadence' ELSE 'freshest_quote_time' END AS selection_method, using_stale_fallback,
           CASE WHEN (p75 - p25) / fix <= 0.015 THEN 'Green' WHEN (p75 - p25) / fix <= 0.035 THEN 'Amber' WHEN (p75 - p25) / fix <= 0.05 THEN 'Red' ELSE 'WITHHOLD' END AS status FROM p"""


@query(_official_sql(24))
def w14_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix.official(src.event_samples(spark, sf_dir), fresh_hours=24).select("day", F.round("fix", 6).alias("fix"), F.array_join("selected_sources", ",").alias("selected_sources"), "selected_quote_time", "selection_method", "using_stale_fallback", "status")


@query(_official_sql(48))
def w14b_official_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix.official(src.event_samples(spark, sf_dir)).select("day", F.round("fix", 6).alias("fix"), F.array_join("selected_sources", ",").alias("selected_sources"), "selected_quote_time", "selection_method", "using_stale_fallback", "status")


@query(f"WITH {EVENT_SAMPLES_SQL}, c AS (SELECT day, source, count(*) AS n, quantile_cont(CAST(CASE WHEN ok THEN value END AS DOUBLE), 0.5) AS v, quantile_cont(CAST(value AS DOUBLE), 0.5) AS d, string_agg(DISTINCT benchmark, '; ' ORDER BY benchmark) FILTER (WHERE NOT ok) AS reasons FROM samples GROUP BY 1, 2) SELECT day, source, n, round(coalesce(v, d), 6) AS estimate, v IS NOT NULL AS eligible, coalesce(reasons, '') AS reasons FROM c")
def a8_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.event_samples(spark, sf_dir)
    v = F.col("value")
    c = s.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"), stats.median(F.when(F.col("ok"), v)).alias("v"), stats.median(v).alias("d"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("benchmark")))), "; ").alias("reasons"))
    return c.select("day", "source", "n", F.round(F.coalesce("v", "d"), 6).alias("estimate"), F.col("v").isNotNull().alias("eligible"), "reasons")


@query("SELECT l_linestatus, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75), 6) AS p75, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 8) AS cv FROM lineitem GROUP BY 1")
def a9_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.dispersion(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice"), median=6, p25=6, p75=6, range=4, cv=8)


_CHANGE = "c AS (SELECT *, abs((fix - lag(fix) OVER (PARTITION BY key ORDER BY day)) / nullif(lag(fix) OVER (PARTITION BY key ORDER BY day), 0)) AS change FROM daily)"
_HISTORY = "h AS (SELECT key, count(fix) AS history_points, stddev_pop(fix) / avg(fix) AS history_cv, quantile_cont(change, 0.5) AS median_abs_change, max(change) AS max_abs_change FROM c GROUP BY 1)"


@query(f"WITH {DAILY_SQL}, {_CHANGE}, {_HISTORY} SELECT key, history_points, round(history_cv, 8) AS history_cv, round(median_abs_change, 8) AS median_abs_change, round(max_abs_change, 8) AS max_abs_change FROM h")
def a10_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.history_stability(src.daily_values(spark, sf_dir), ["key"], "day", "fix"), history_cv=8, median_abs_change=8, max_abs_change=8)


@query(f"""WITH {DAILY_SQL}, {_CHANGE}, {_HISTORY}, s AS (SELECT *, 1 + ascii(key) % 4 AS n, CAST(history_points % 3 AS INTEGER) AS outliers, history_cv / 10 AS cv FROM h),
    x AS (SELECT key, n, greatest(0, least(n / 3.0, 1) * 40 + greatest(0, 1 - least(cv, 0.08) / 0.08) * 35 + greatest(0, 1 - least(median_abs_change, 0.06) / 0.06) * 25 * least(history_points / 7.0, 1) - least(outliers * 5.0, 15)) AS raw FROM s)
    SELECT key, round(CAST(CASE WHEN n < 2 THEN least(raw, 55) ELSE raw END AS DOUBLE), 2) AS confidence FROM x""")
def a11_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = robust.history_stability(src.daily_values(spark, sf_dir), ["key"], "day", "fix")
    n = 1 + F.ascii("key") % 4
    return h.select("key", robust.model_confidence(n, F.col("history_cv") / 10, F.col("history_points"), F.col("median_abs_change"), F.col("history_points") % 3).alias("confidence"))


_TRIM = """t AS (SELECT {k} AS k, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t})"""


@query(f"WITH {_TRIM.format(k='l_suppkey % 50', v='l_extendedprice', t='lineitem')} SELECT k, round(avg(v), 4) AS trimmed FROM t WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1")
def a12_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.trimmed_mean(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), "l_extendedprice"), ["k"], "l_extendedprice"), trimmed=4)


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) FILTER (WHERE l_discount > 0) / sum(l_discount) FILTER (WHERE l_discount > 0), 4) AS weighted FROM lineitem GROUP BY 1")
def a13_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("weighted"))


_CLAMPS = """w AS (SELECT *, CASE category WHEN 'direct_shop' THEN 1.0 WHEN 'settlement_exchange' THEN 0.88 WHEN 'market_channel' THEN 0.68 WHEN 'aggregator' THEN 0.55 ELSE 0.5 END::DOUBLE
    * greatest(0.45, least(1.15, quality / 100)) * greatest(0.35, least(1.10, freshness / 100)) * greatest(0.55, least(1.10, 0.55 + directness / 200)) * greatest(0.60, least(1.10, 0.60 + readiness / 200)) AS weight FROM records)"""
_MAD = """m1 AS (SELECT *, count(*) OVER (PARTITION BY basket) AS n, quantile_cont(rate, 0.5) OVER (PARTITION BY basket) AS med FROM w),
    m2 AS (SELECT *, quantile_cont(abs(rate - med), 0.5) OVER (PARTITION BY basket) AS mad FROM m1),
    m3 AS (SELECT *, n >= 5 AND mad > 0 AND abs(rate - med) / mad > 4 AND abs(rate - med) / med > 0.025 AS outlier FROM m2)"""


def _weighted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lit(0.5)
    for c, w in CATEGORY_WEIGHT.items():
        base = F.when(F.col("category") == c, w).otherwise(base)
    return src.basket_records(spark, sf_dir).withColumn("weight", robust.basket_weight(base, F.col("quality"), F.col("freshness"), F.col("directness"), F.col("readiness")))


@query(f"""WITH {BASKET_SQL}, {_CLAMPS}, {_MAD}, cl AS (SELECT * FROM m3 WHERE NOT outlier), rm AS (SELECT basket, count_if(outlier) AS outliers_removed FROM m3 GROUP BY 1),
    per AS (SELECT basket, handle, sum(weight) AS hw, max(freshness) AS hf FROM cl GROUP BY 1, 2), hd AS (SELECT basket, count(*) AS channels, count_if(hf >= 85) AS fresh_channels, max(hw) / sum(hw) AS top_share FROM per GROUP BY 1),
    ra AS (SELECT basket, count(*) AS usable, quantile_cont(rate, 0.5) AS median_rate, sum(rate * weight) / sum(weight) AS weighted_rate, stddev_pop(rate) / avg(rate) AS cv, avg(freshness) AS af, sum(CASE WHEN category = 'direct_shop' THEN weight ELSE 0 END) / sum(weight) AS ds FROM cl GROUP BY 1),
    j AS (SELECT *, round(CAST(least(30.0, usable * 3.0) + least(25.0, channels * 7.0) + greatest(0.0, 25.0 - cv * 120) + greatest(0.0, least(10.0, af / 10)) + greatest(0.0, least(10.0, ds * 10)) AS DOUBLE), 2) AS confidence FROM ra JOIN hd USING (basket) JOIN rm USING (basket)),
    x AS (SELECT *, CASE WHEN usable < 4 THEN 'insufficient_usable_records' WHEN channels < 2 THEN 'single_channel_concentration' WHEN cv > 0.18 THEN 'high_dispersion' WHEN top_share > 0.78 THEN 'concentrated_single_source' WHEN confidence < 55 THEN 'low_confidence' ELSE '' END AS suppression_reason FROM j)
    SELECT basket, usable, channels, fresh_channels, outliers_removed, round(median_rate, 2) AS median_rate, round(weighted_rate, 2) AS weighted_rate, round(cv, 6) AS cv, round(top_share, 6) AS top_share, confidence, round((weighted_rate - 1450000) / 1450000 * 100, 4) AS spread_pct, suppression_reason = '' AS publishable, suppression_reason FROM x""")
def a14_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.summarize_baskets(_weighted_records(spark, sf_dir), 1_450_000.0).drop("trimmed_rate"), median_rate=2, weighted_rate=2, cv=6, top_share=6, spread_pct=4)


@query(f"WITH {BASKET_SQL}, {_CLAMPS} SELECT basket, handle, round(sum(weight), 6) AS weight, count(*) AS n FROM w GROUP BY 1, 2")
def a21_weight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted_records(spark, sf_dir).groupBy("basket", "handle").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BASKET_SQL}, w AS (SELECT * FROM records), {_MAD} SELECT basket, count(*) AS n, min(rate) AS min, max(rate) AS max, round(max(med), 4) AS median, round(max(mad), 4) AS mad, round(quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25), 4) AS iqr, round(stddev_pop(rate), 4) AS std, round(stddev_pop(rate) / max(med), 8) AS cv_median FROM m3 GROUP BY 1""")
def a19_dispersion_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.dispersion_full(src.basket_records(spark, sf_dir), ["basket"], "rate"), median=4, mad=4, iqr=4, std=4, cv_median=8)


@query("""WITH p AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), s AS (SELECT *, w / sum(w) OVER (PARTITION BY l_returnflag) AS share, row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, l_suppkey) AS k FROM p)
    SELECT l_returnflag, count(*) AS n_members, round(max(share), 8) AS top_share, round(sum(share) FILTER (WHERE k <= 3), 8) AS top3_share, round(sum(share * share), 8) AS hhi, round(1 / sum(share * share), 4) AS effective_n FROM s GROUP BY 1""")
def a20_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.concentration(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_quantity")), top_share=8, top3_share=8, hhi=8, effective_n=4)


@query(f"""WITH {DAILY_SQL} SELECT a.day, a.key, a.fix, round((a.fix - b.fix) / b.fix * 100, 6) AS trend_pct FROM (SELECT *, day - INTERVAL 7 DAY AS t FROM daily) a ASOF LEFT JOIN (SELECT CAST(day AS TIMESTAMP) AS d2, key, fix FROM daily) b ON a.key = b.key AND a.t >= b.d2""")
def j5_trend_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(asof.trend(src.daily_values(spark, sf_dir), ["key"], "day", "fix"), trend_pct=6)


@query(f"""WITH {DAILY_SQL}, c AS (SELECT a.day, a.key, b.day AS bd, b.fix AS bf, row_number() OVER (PARTITION BY a.key, a.day ORDER BY b.day DESC) AS k FROM daily a JOIN daily b ON a.key = b.key AND b.day < a.day AND b.fix > 150000 WHERE a.fix <= 150000)
    SELECT a.day, a.key, a.fix, CASE WHEN a.day - c.bd <= 45 THEN c.bd END AS matched_day, CASE WHEN a.day - c.bd <= 45 THEN c.bf END AS matched_fix FROM daily a LEFT JOIN c ON a.day = c.day AND a.key = c.key AND c.k = 1 WHERE a.fix <= 150000""")
def j6_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.daily_values(spark, sf_dir)
    return asof.backward(d.where("fix <= 150000"), d, ["key"], "day", ["fix"], F.col("fix") > 150000, 45)


@query(f"WITH {DAILY_SQL} SELECT day, key, fix, lag(day) OVER (PARTITION BY key ORDER BY day) AS previous_day, round(fix - lag(fix) OVER (PARTITION BY key ORDER BY day), 4) AS delta FROM daily")
def j7_previous_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy("day")
    return src.daily_values(spark, sf_dir).select("day", "key", "fix", F.lag("day").over(w).alias("previous_day"), F.round(F.col("fix") - F.lag("fix").over(w), 4).alias("delta"))


@query(f"""WITH {EVENT_SAMPLES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY day, source ORDER BY sampled_at, event_id) AS i FROM samples), p AS (SELECT day, i, quantile_cont(CAST(value AS DOUBLE), 0.5) AS peer_median FROM s WHERE source IN ('s1', 's2', 's3') AND ok AND NOT stale AND value > 0 GROUP BY 1, 2),
    j AS (SELECT s.*, peer_median, abs(value - peer_median) / nullif(peer_median, 0) AS dev FROM s LEFT JOIN p USING (day, i) WHERE source = 's0')
    SELECT event_id, day, round(peer_median, 6) AS peer_median, CASE WHEN NOT ok OR stale OR value IS NULL THEN NULL WHEN peer_median IS NULL THEN NULL ELSE round(dev, 6) END AS peer_deviation, CASE WHEN NOT ok OR stale OR value IS NULL THEN 'skipped_sample_not_valid' WHEN peer_median IS NULL THEN 'skipped_no_peer_values' WHEN dev > 0.2 THEN 'failed' ELSE 'passed' END AS peer_result FROM j""")
def j13_peer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.event_samples(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("day", "source").orderBy("sampled_at", "event_id"))
    s = s.withColumn("attempt", F.struct("day", i.alias("i")))
    return _r(fix.peer_validation(s, "s0", ["s1", "s2", "s3"]).select("event_id", "day", "peer_median", "peer_deviation", "peer_result"), peer_median=6, peer_deviation=6)


@query(f"WITH {TRADE_SAMPLES_SQL}, {_MEDIANS}, {_BANDS}, s AS (SELECT *, {_STATUS} AS status FROM fixed) SELECT day, benchmark, round(fix, 4) AS fix, status FROM s WHERE status IN ('Green', 'Amber', 'Red') AND NOT withheld AND fix > 0")
def f1_public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fix.fixes(src.trade_samples(spark, sf_dir))
    return f.where(fix.is_public(F.col("status"), F.col("withheld"), F.col("fix"))).select("day", "benchmark", F.round("fix", 4).alias("fix"), "status")


@query("SELECT event_id, ts FROM events WHERE hour(ts) * 60 + minute(ts) BETWEEN 825 AND 855")
def f3_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(times.in_window(F.col("ts"))).select("event_id", "ts")


@query(f"WITH {EVENT_SAMPLES_SQL} SELECT event_id, quote_time IS NOT NULL AND sampled_at - quote_time <= INTERVAL 48 HOUR AS fresh, quote_time IS NOT NULL AND sampled_at - quote_time <= INTERVAL 1080 HOUR AS within_horizon FROM samples")
def f5_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.event_samples(spark, sf_dir)
    return s.select("event_id", times.fresh(F.col("quote_time"), F.col("sampled_at")).alias("fresh"), times.fresh(F.col("quote_time"), F.col("sampled_at"), 1080).alias("within_horizon"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS buy, l_extendedprice * (1.02 - l_tax) AS sell FROM lineitem), s AS (SELECT *, CASE WHEN buy <= sell AND sell > 0 THEN (sell - buy) / sell END AS spread FROM q)
    SELECT l_orderkey, l_linenumber, CASE WHEN buy IS NULL OR sell IS NULL THEN 'missing USD buy/sell quote' WHEN buy > sell THEN 'buy quote above sell quote' WHEN sell <= 0 THEN 'invalid sell quote' WHEN spread <= 0 THEN 'non-positive bid/ask spread' WHEN spread > 0.05 THEN 'bid/ask spread exceeds configured maximum' END AS reason, round(spread, 8) AS spread FROM s""")
def f7_spread_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    c = labels.spread_check(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1.02 - F.col("l_tax")), 0.05)
    return t.select("l_orderkey", "l_linenumber", c["reason"].alias("reason"), F.round(c["spread_pct"], 8).alias("spread"))


@query(f"WITH {DAILY_SQL} SELECT day, key, round(abs((fix - lag(fix) OVER (PARTITION BY key ORDER BY day)) / lag(fix) OVER (PARTITION BY key ORDER BY day)), 8) AS change FROM daily")
def w1_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.lag("fix").over(Window.partitionBy("key").orderBy("day"))
    return src.daily_values(spark, sf_dir).select("day", "key", F.round(F.abs((F.col("fix") - prior) / prior), 8).alias("change"))


@query(f"WITH {DAILY_SQL} SELECT day, key, fix FROM daily, (SELECT max(day) AS m FROM daily) WHERE day > m - 14")
def w3_trailing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.daily_values(spark, sf_dir)
    return d.crossJoin(F.broadcast(d.agg(F.max("day").alias("m")))).where(F.col("day") > F.date_sub("m", 14)).drop("m")


@query(f"WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS k FROM daily) SELECT day, key, fix FROM r WHERE k <= 7")
def w4_last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.col("day").desc())
    return src.daily_values(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 7").drop("k")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, CAST(ts AS DATE) AS day, event_id, value FROM r WHERE k = 1")
def w7_last_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return dedup.first_by(e, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "day", "event_id", "value")


@query(f"WITH {BASKET_SQL}, w AS (SELECT * FROM records), {_MAD} SELECT basket, handle, rate, round(med, 4) AS med, round(mad, 4) AS mad, outlier FROM m3")
def w10_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(robust.outliers_basket(src.basket_records(spark, sf_dir), ["basket"], "rate").select("basket", "handle", "rate", "med", "mad", "outlier"), med=4, mad=4)


@query("WITH r AS (SELECT *, max(ts) OVER () AS m FROM events) SELECT event_id, ts FROM r WHERE ts >= m - INTERVAL 6 DAY")
def w13_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.prune_days(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 7)
