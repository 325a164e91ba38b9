"""Queries of scores, classes, regional summaries, payloads and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import payloads, scores
from ratemill.operators import fix, publish, regional
from ratemill.operators.quotes import spread
from ratemill.plans.core import _BANDS, _CLAMPS, _MAD, _MEDIANS, _STATUS, _weighted_records
from ratemill.plans.registry import query, table
from ratemill.sources import samples as src
from ratemill.sources.samples import BASKET_SQL, TRADE_SAMPLES_SQL

_KINDS = ("exchange_shop", "regional_market_channel", "settlement_exchange", "aggregator", "unknown", "remittance_exchange")
#: Customers as discovered sources.
_SOURCES_SQL = """f AS (SELECT c_custkey AS id, c_custkey % 101 AS parse, c_custkey % 13 AS quotes, c_custkey % 7 AS pairs, c_custkey % 2 = 0 AS b2, c_custkey % 3 = 0 AS b3, c_custkey % 5 = 0 AS b5, c_custkey % 11 = 0 AS b11, c_custkey % 17 AS n, c_custkey * 7 % 500 AS days,
    CASE c_custkey % 6 WHEN 0 THEN 'exchange_shop' WHEN 1 THEN 'regional_market_channel' WHEN 2 THEN 'settlement_exchange' WHEN 3 THEN 'aggregator' WHEN 4 THEN 'unknown' ELSE 'remittance_exchange' END AS kind,
    CASE c_custkey % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'recent' WHEN 2 THEN 'stale' ELSE 'old' END AS fresh, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok_no_text' ELSE 'failed' END AS status FROM customer)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 101).alias("parse"), (k % 13).alias("quotes"), (k % 7).alias("pairs"), *[(k % m == 0).alias(f"b{m}") for m in (2, 3, 5, 11)], (k % 17).alias("n"), (k * 7 % 500).alias("days"), pick(_KINDS).alias("kind"), pick(("fresh", "recent", "stale", "old")).alias("fresh"), pick(("ok", "ok_no_text", "failed")).alias("status")
    )


def _c(name: str):
    return F.col(name)


_FP = "CASE WHEN b11 THEN CASE WHEN status = 'ok_no_text' THEN 0 ELSE 1 END WHEN days <= 3 THEN 12 WHEN days <= 14 THEN 10 WHEN days <= 45 THEN 7 WHEN days <= 180 THEN 4 WHEN days <= 365 THEN 2 ELSE 0 END"
_SP = "CASE WHEN status = 'ok' THEN least(CASE WHEN quotes >= 6.0 THEN 4 WHEN quotes >= 3.2 THEN 2 ELSE 0 END + CASE WHEN pairs >= 2.0 THEN 4 WHEN pairs > 0 THEN 2 ELSE 0 END + CASE WHEN n >= 7 THEN 2 ELSE 0 END + CASE WHEN parse >= 70 THEN 2 ELSE 0 END, 12) WHEN status = 'ok_no_text' THEN 1 ELSE 0 END"
_CP = "CASE WHEN kind = 'unknown' THEN 1 WHEN n <= 1 THEN 10 WHEN n <= 3 THEN 9 WHEN n <= 6 THEN 7 WHEN n <= 10 THEN 5 ELSE 3 END"


@query(f"""WITH {_SOURCES_SQL}, p AS (SELECT *, {_FP} AS freshness, {_CP} AS contribution, {_SP} AS stability FROM f),
    s AS (SELECT *, least(100, greatest(0, CAST(round_even(CAST(least(parse, 100) * 0.35 + least(quotes / 8.0 * 15, 15) + least(pairs / 4.0 * 20, 20) + CASE WHEN b2 THEN 12 ELSE 0 END + freshness + 2 + contribution + stability
        + CASE kind WHEN 'exchange_shop' THEN 6 WHEN 'regional_market_channel' THEN 8 WHEN 'settlement_exchange' THEN 4 WHEN 'aggregator' THEN -8 ELSE -10 END - CASE WHEN b5 THEN 12 ELSE 0 END AS DOUBLE), 0) AS INTEGER))) AS score FROM p)
    SELECT id, freshness, contribution, stability, score, CASE WHEN kind IN ('unknown', 'aggregator') AND quotes = 0 AND NOT b2 THEN 'reject' WHEN score >= 75 AND freshness >= 4 AND kind IN ('exchange_shop', 'regional_market_channel') AND (pairs >= 4 OR quotes >= 8) THEN 'P1'
        WHEN score >= 60 AND freshness >= 2 AND kind IN ('exchange_shop', 'regional_market_channel', 'settlement_exchange') AND (quotes > 0 OR b2 OR freshness >= 7) THEN 'P2' WHEN score >= 30 AND kind <> 'unknown' THEN 'monitor_only' WHEN score >= 40 AND b2 THEN 'monitor_only' ELSE 'reject' END AS bucket FROM s""")
def c5_operational_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _sources(spark, sf_dir).select("*", scores.freshness_points(_c("days"), _c("b11"), _c("status") == "ok_no_text").alias("freshness"), scores.contribution_points(_c("kind"), _c("n")).alias("contribution"), scores.stability_points(_c("status"), _c("quotes"), _c("pairs"), _c("n"), _c("parse"), F.lit(8.0), F.lit(4.0)).alias("stability"))
    s = f.withColumn("score", scores.operational_score(_c("parse"), _c("quotes"), _c("pairs"), _c("b2"), _c("kind"), _c("b5"), [_c("freshness"), F.lit(2), _c("contribution"), _c("stability")], F.lit(8.0), F.lit(4.0)))
    return s.select("id", "freshness", "contribution", "stability", "score", scores.operational_bucket(_c("kind"), _c("quotes"), _c("pairs"), _c("b2"), _c("score"), _c("freshness")).alias("bucket"))


_ONE = "CASE WHEN {} THEN {} ELSE 0 END"


@query(f"""WITH {_SOURCES_SQL}, s AS (SELECT *, least(100, greatest(0, CAST(round_even(CAST(0.45 * parse + least(n * 6, 18) + {_ONE.format('b2', 12)} + {_ONE.format('b3', 10)} + {_ONE.format('b5', 6)} + {_ONE.format('b11', 8)} + CASE fresh WHEN 'fresh' THEN 16 WHEN 'recent' THEN 10 WHEN 'stale' THEN -8 ELSE 0 END + {_ONE.format("kind IN ('exchange_shop', 'remittance_exchange', 'settlement_exchange')", 8)} AS DOUBLE), 0) AS INTEGER))) AS reliability FROM f)
    SELECT id, reliability, CASE WHEN NOT b3 OR n = 0 THEN 'no_usable_signal' WHEN fresh = 'stale' THEN 'stale' WHEN n >= 3 AND b2 AND reliability >= 68 THEN 'publishable' WHEN n >= 1 AND reliability >= 42 THEN 'monitor_only' ELSE 'no_usable_signal' END AS use_status FROM s""")
def c23_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir).withColumn("reliability", scores.reliability(_c("parse"), _c("fresh"), _c("b2"), _c("n"), _c("b3"), _c("b5"), _c("b11"), _c("kind")))
    return s.select("id", "reliability", scores.use_status(_c("n"), _c("b2"), _c("fresh"), _c("reliability"), _c("b3")).alias("use_status"))


@query(f"WITH {_SOURCES_SQL}, g AS (SELECT kind, count_if(b2) AS p, count_if(b3) AS m, count(*) AS r FROM f WHERE id < 60 GROUP BY 1) SELECT kind, CASE WHEN p >= 2 AND r >= 6 THEN 'full_card' WHEN p >= 1 OR (m >= 2 AND r >= 3) THEN 'monitor_card' ELSE 'still_hidden' END AS support FROM g")
def c25_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sources(spark, sf_dir).where("id < 60").groupBy("kind").agg(F.count_if("b2").alias("p"), F.count_if("b3").alias("m"), F.count(F.lit(1)).alias("r"))
    return g.select("kind", scores.support(_c("p"), _c("m"), _c("r")).alias("support"))


@query(f"""WITH {_SOURCES_SQL} SELECT id, least(100, {_ONE.format('b2', 25)} + {_ONE.format('b3', 20)} + least(quotes * 4, 20) + least(pairs * 5, 15) + {_ONE.format('b5', 8)} + {_ONE.format('b11', 8)} + {_ONE.format('b3', 7)} + {_ONE.format("kind = 'remittance_exchange'", 6)} + 6) AS business,
    least(100, parse + 10 + {_ONE.format('b2', 8)} + {_ONE.format('b3', 6)} + {_ONE.format('b5', 8)} + {_ONE.format('b11', 10)} + {_ONE.format('b2', 10)} + {_ONE.format('b3', 8)} + {_ONE.format('b5', 10)} + {_ONE.format('b11', 6)} + {_ONE.format("kind IN ('exchange_shop', 'remittance_exchange', 'settlement_exchange')", 10)}) AS uae,
    least(100, least(quotes * 8, 40) + least(pairs * 10, 30) + {_ONE.format('b2', 8)} + {_ONE.format('b3', 8)} + 6 + {_ONE.format("kind IN ('exchange_shop', 'regional_market_channel', 'settlement_exchange')", 8)}) AS multilingual,
    least(100, least(quotes * 8, 40) + {_ONE.format('b2', 18)} + {_ONE.format('b3', 12)} + {_ONE.format('b5', 12)} + {_ONE.format('b11', 8)} + {_ONE.format('b2', 6)} + {_ONE.format('b3', 4)}) AS parse_uae FROM f""")
def c26_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b2, b3, b5, b11 = (_c(x) for x in ("b2", "b3", "b5", "b11"))
    flags = dict(zip(("website", "instagram", "telegram", "whatsapp", "transfer", "page", "post", "usd", "aed"), (F.lit(True), b2, b3, b5, b11, b2, b3, b5, b11)))
    return _sources(spark, sf_dir).select(
        "id", scores.candidate_business(b2, b3, _c("quotes"), _c("pairs"), b5, b11, b3, _c("kind"), F.lit("UAE")).alias("business"), scores.candidate_uae(_c("kind"), flags, _c("parse")).alias("uae"),
        scores.parse_multilingual(_c("quotes"), _c("pairs"), b2, b3, F.lit("telegram"), _c("kind")).alias("multilingual"), scores.parse_uae(_c("quotes"), b2, b3, b11, b2, b3, b5).alias("parse_uae"),
    )


@query(f"""WITH {_SOURCES_SQL}, s AS (SELECT *, least(quotes / greatest(n, 1), 1.0) AS a, least(pairs / greatest(n, 1), 1.0) AS b, least(n / greatest(days, 1), 1.0) AS c, least(days / 30.0, 1.0) AS d FROM f)
    SELECT id, CASE WHEN days <= 0 THEN 0 ELSE CAST(round_even(CAST(100 * (0.40 * a + 0.25 * b + 0.20 * c + 0.15 * d) * CASE WHEN c < 0.30 THEN 0.75 ELSE 1 END * CASE WHEN quotes = 0 THEN 0.5 ELSE 1 END AS DOUBLE), 0) AS INTEGER) END AS points FROM s""")
def c12_parseable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("id", scores.parseable(_c("quotes"), _c("n"), _c("days"), _c("pairs")).alias("points"))


@query(f"""WITH {_SOURCES_SQL} SELECT id, CASE WHEN kind = 'exchange_shop' THEN 'direct_shop' WHEN kind IN ('settlement_exchange', 'regional_market_channel', 'aggregator') THEN kind WHEN b2 THEN 'direct_shop' WHEN b3 THEN 'market_channel' ELSE 'unknown' END AS category FROM f""")
def c14_source_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("id", scores.source_category(F.when(_c("b3"), "Market X").otherwise("none"), _c("b2"), _c("kind")).alias("category"))


@query("SELECT c_custkey, round(CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal * 3.6725 WHEN 2 THEN CASE WHEN c_nationkey < 10 THEN c_acctbal / 1.14 END ELSE CASE WHEN c_nationkey >= 10 THEN c_acctbal / 100 * 1310 END END, 6) AS usd_rial FROM customer")
def m4_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    cur = F.when(k == 0, "USD").when(k == 1, "AED").when(k == 2, "EUR").otherwise("IQD")
    v = scores.per_hundred(F.col("c_acctbal"), cur, F.lit("هر 100 دینار"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scores.comparable_rial(v, cur, F.when(F.col("c_nationkey") < 10, "Germany").otherwise("Iraq")), 6).alias("usd_rial"))


_FRESH = "CASE WHEN freshness >= 85 THEN 'fresh' WHEN freshness >= 60 THEN 'recent' WHEN freshness >= 40 THEN 'stale' ELSE 'old' END"


@query(f"""WITH {BASKET_SQL}, {_CLAMPS}, r AS (SELECT basket AS locality, handle, rate, weight, quality AS parse, {_FRESH} AS fresh FROM w), a AS (SELECT locality, count(*) AS n, count(DISTINCT handle) AS sources, count(DISTINCT CASE WHEN fresh = 'fresh' THEN handle END) AS fresh_sources, quantile_cont(rate, 0.5) AS median_rate, sum(rate * weight) / sum(weight) AS weighted_rate,
        CASE max(CASE fresh WHEN 'fresh' THEN 3 WHEN 'recent' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END) WHEN 3 THEN 'fresh' WHEN 2 THEN 'recent' WHEN 1 THEN 'stale' ELSE 'old' END AS freshness, stddev_pop(rate) / avg(rate) AS cv, avg(parse) AS parse FROM r GROUP BY 1),
    b AS (SELECT *, CASE WHEN n <= 1 THEN 'low' WHEN cv <= 0.03 THEN 'low' WHEN cv <= 0.08 THEN 'medium' ELSE 'high' END AS dispersion_level FROM a),
    c AS (SELECT *, round(CAST(greatest(0.0, least(100.0, least(28.0, n * 4.0) + least(18.0, sources * 6.0) + least(20.0, parse / 4) + CASE freshness WHEN 'fresh' THEN 16 WHEN 'recent' THEN 10 WHEN 'stale' THEN 3 ELSE 0 END + CASE dispersion_level WHEN 'low' THEN 12 WHEN 'medium' THEN 6 ELSE 0 END)) AS DOUBLE), 2) AS confidence FROM b),
    d AS (SELECT *, CASE WHEN freshness IN ('fresh', 'recent') AND n >= 4 AND sources >= 2 AND confidence >= 58 THEN 'publish' WHEN n >= 2 AND confidence >= 36 THEN 'monitor' ELSE 'hide' END AS state FROM c)
    SELECT locality, n, sources, fresh_sources, round(median_rate, 2) AS median_rate, round(weighted_rate, 2) AS weighted_rate, round((weighted_rate - 1450000) / 1450000 * 100, 4) AS spread_pct, freshness, dispersion_level, confidence, state, CASE WHEN state = 'publish' THEN '' WHEN state = 'hide' THEN 'insufficient_signal' WHEN freshness IN ('stale', 'old') THEN 'needs_more_fresh_sources' ELSE 'limited_coverage' END AS reason FROM d""")
def a16_locality_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = F.when(F.col("freshness") >= 85, "fresh").when(F.col("freshness") >= 60, "recent").when(F.col("freshness") >= 40, "stale").otherwise("old")
    r = _weighted_records(spark, sf_dir).select(F.col("basket").alias("locality"), "handle", "rate", "weight", F.col("quality").alias("parse"), fresh.alias("fresh"))
    return regional.board(r, 1_450_000.0).withColumns({"median_rate": F.round("median_rate", 2), "weighted_rate": F.round("weighted_rate", 2), "spread_pct": F.round("spread_pct", 4)})


@query(f"""WITH {BASKET_SQL}, {_CLAMPS}, {_MAD}, cl AS (SELECT * FROM m3 WHERE NOT outlier), per AS (SELECT basket, handle, sum(weight) AS hw, max(freshness) AS hf FROM cl GROUP BY 1, 2), hd AS (SELECT basket, count(*) AS sources, max(hw) / sum(hw) AS top_share, quantile_cont(hf, 0.5) AS mf, count_if(hf >= 85) AS fresh_sources FROM per GROUP BY 1),
    a AS (SELECT basket, count(*) AS n, quantile_cont(rate, 0.5) AS median_rate, sum(rate * weight) / sum(weight) AS weighted_rate, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_pop(rate) / avg(rate) END AS cv, avg(freshness) AS af, avg(quality) AS aq FROM cl GROUP BY 1),
    j AS (SELECT *, greatest(af, mf) AS signal, (weighted_rate - 1450000) / 1450000 * 100 AS spread FROM a JOIN hd USING (basket)), c AS (SELECT *, round(CAST(greatest(0, least(100, least(32.0, n * 3.5) + least(18.0, sources * 6.0) + greatest(0.0, 20.0 - cv * 90) + least(15.0, signal / 6.5) + least(15.0, aq / 7.0))) AS DOUBLE), 2) AS confidence FROM j),
    x AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_usable_records' WHEN confidence < 42 THEN 'low_confidence' WHEN signal < 35 THEN 'stale_signal' WHEN cv > 0.28 THEN 'high_dispersion' WHEN top_share > 0.96 AND n < 4 THEN 'single_source_dominance' WHEN abs(spread) > 35 AND sources < 4 THEN 'extreme_divergence' ELSE '' END AS reason FROM c)
    SELECT basket, n, sources, fresh_sources, round(median_rate, 2) AS median_rate, round(weighted_rate, 2) AS weighted_rate, round(cv, 8) AS cv, round(top_share, 8) AS top_share, confidence, round(spread, 6) AS spread_pct, reason = '' AS publishable, reason FROM x""")
def a15_enriched_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regional.enriched(_weighted_records(spark, sf_dir), 1_450_000.0).withColumns({c: F.round(c, n) for c, n in (("median_rate", 2), ("weighted_rate", 2), ("cv", 8), ("top_share", 8), ("spread_pct", 6))})


_ATTEMPT_SQL = f"""{TRADE_SAMPLES_SQL}, {_MEDIANS}, {_BANDS}, att AS (SELECT day, CAST(day AS TIMESTAMP) + to_minutes(CAST(820 + 12 * ascii(benchmark) % 60 AS INTEGER)) AS "at", fix, {_STATUS} AS status, withheld, benchmark FROM fixed)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fix.fixes(src.trade_samples(spark, sf_dir))
    return f.select("day", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), 820 + 12 * F.ascii("benchmark") % 60)).alias("at"), "fix", "status", "withheld", "benchmark")


@query(f"""WITH {_ATTEMPT_SQL}, g AS (SELECT *, status IN ('Green', 'Amber', 'Red') AND NOT withheld AND fix > 0 AND hour("at") * 60 + minute("at") BETWEEN 825 AND 855 AS good FROM att), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY good DESC, "at" DESC, fix DESC) AS k, count(*) OVER (PARTITION BY day) AS attempts, count_if(good) OVER (PARTITION BY day) AS valid_candidates FROM g)
    SELECT day, "at", round(fix, 6) AS fix, status, attempts, valid_candidates, CASE WHEN valid_candidates > 0 THEN 'latest_valid_in_window' ELSE 'latest_attempt' END AS strategy FROM r WHERE k = 1""")
def w8_pick_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.pick_attempt(_attempts(spark, sf_dir)).select("day", "at", F.round("fix", 6).alias("fix"), "status", "attempts", "valid_candidates", "strategy")


@query(f"""WITH {_ATTEMPT_SQL}, d AS (SELECT DISTINCT day FROM att), k AS (SELECT unnest(['open_market', 'official', 'crypto_usdt']) AS benchmark) SELECT d.day, k.benchmark, round(a.fix, 6) AS fix, coalesce(a.status, 'WITHHOLD') AS status, coalesce(a.withheld, TRUE) AS withheld FROM d CROSS JOIN k LEFT JOIN att a ON a.day = d.day AND a.benchmark = k.benchmark""")
def y6_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir)
    return publish.placeholders(a.select("day").distinct(), ["open_market", "official", "crypto_usdt"], a).withColumn("fix", F.round("fix", 6))


@query("SELECT day, failure FROM (SELECT day, unnest(list_filter([CASE WHEN tries > 0 AND reason = 'no intraday samples' THEN 'intraday_samples_exist' END, CASE WHEN held AND valid_candidates > 0 THEN 'withheld_despite_candidates' END, CASE WHEN NOT held AND fix IS NULL THEN 'published_without_fix' END], lambda x: x IS NOT NULL)) AS failure FROM (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN max(o_orderkey) % 3 > 0 THEN avg(o_totalprice) END AS fix, max(o_orderkey) % 2 = 0 AS held, CASE WHEN max(o_orderkey) % 5 = 0 THEN 'no intraday samples' ELSE '' END AS reason, max(o_orderkey) % 4 AS valid_candidates, count(*) AS tries FROM orders GROUP BY 1))")
def f24_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    m = F.max("o_orderkey")
    latest = o.groupBy("day").agg(F.when(m % 3 > 0, F.avg("o_totalprice")).alias("fix"), (m % 2 == 0).alias("withheld"), F.when(m % 5 == 0, "no intraday samples").otherwise("").alias("reason"), (m % 4).alias("valid_candidates"), F.lit(True).alias("official_ok"))
    tries = o.select("day", F.lit(None).cast("double").alias("fix"), F.lit(True).alias("withheld"), F.lit(False).alias("official_ok"))
    return publish.guardrails(latest, tries)


def _payloads(spark: SparkSession, sf_dir: str, which: str = "o_orderkey < 400") -> DataFrame:
    """Orders as nested quote payloads."""
    o = spread(table(spark, sf_dir, "orders").where(which))
    p = F.col("o_totalprice").cast("string")
    body = F.concat(F.lit('{"data": {"USD-IRR": {"price": "'), p, F.lit('", "updated_at": "2024-01-01T10:00:00Z"}, "list": [{"symbol": "eur", "sell": "1,000"}, {"symbol": "usd_irr", "value": '), p, F.lit('}], "usd_irr": "'), p, F.lit('"}, "ts": 1700000000}'))
    return o.select("o_orderkey", "o_totalprice", body.alias("body"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey < 400")
def n2_symbol_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.symbol_value(_payloads(spark, sf_dir), "o_orderkey", "body", ("usd-irr",), 4)


@query("SELECT o_orderkey AS key, unnest(['data.USD-IRR.price', 'data.USD-IRR.updated_at', 'data.list[0].symbol', 'data.list[0].sell', 'data.list[1].symbol', 'data.list[1].value', 'data.usd_irr', 'ts']) AS path FROM orders WHERE o_orderkey < 400")
def n1b_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.leaves(_payloads(spark, sf_dir), "o_orderkey", "body", 4).select("key", "path")


@query("SELECT o_orderkey AS key, TIMESTAMP '2024-01-01 10:00:00' AS quote_time FROM orders WHERE o_orderkey < 400")
def n4_quote_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.quote_time(_payloads(spark, sf_dir), "o_orderkey", "body", 4).withColumn("quote_time", F.col("quote_time").cast("timestamp_ntz"))


# The three queries above and c25_support read a fixed subset of ids, as their SQL does; these read all rows.


@query(f"WITH {_SOURCES_SQL}, g AS (SELECT kind, count_if(b2) AS p, count_if(b3) AS m, count(*) AS r FROM f GROUP BY 1) SELECT kind, CASE WHEN p >= 2 AND r >= 6 THEN 'full_card' WHEN p >= 1 OR (m >= 2 AND r >= 3) THEN 'monitor_card' ELSE 'still_hidden' END AS support FROM g")
def c25_support_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sources(spark, sf_dir).groupBy("kind").agg(F.count_if("b2").alias("p"), F.count_if("b3").alias("m"), F.count(F.lit(1)).alias("r"))
    return g.select("kind", scores.support(_c("p"), _c("m"), _c("r")).alias("support"))


@query("SELECT o_orderkey AS key, o_totalprice AS value FROM orders")
def n2_symbol_value_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.symbol_value(_payloads(spark, sf_dir, "true"), "o_orderkey", "body", ("usd-irr",), 4)


@query("SELECT o_orderkey AS key, unnest(['data.USD-IRR.price', 'data.USD-IRR.updated_at', 'data.list[0].symbol', 'data.list[0].sell', 'data.list[1].symbol', 'data.list[1].value', 'data.usd_irr', 'ts']) AS path FROM orders")
def n1b_leaves_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.leaves(_payloads(spark, sf_dir, "true"), "o_orderkey", "body", 4).select("key", "path")


@query("SELECT o_orderkey AS key, TIMESTAMP '2024-01-01 10:00:00' AS quote_time FROM orders")
def n4_quote_time_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.quote_time(_payloads(spark, sf_dir, "true"), "o_orderkey", "body", 4).withColumn("quote_time", F.col("quote_time").cast("timestamp_ntz"))
