"""Queries of surveys: customers stand for channels, candidates and reviews, orders for their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import rules
from ratemill.operators import publish, surveys
from ratemill.operators.quotes import once
from ratemill.plans.registry import query, table
from ratemill.plans.rules import _SQL, cases
from ratemill.sources import samples as src
from ratemill.sources.samples import BASKET_SQL, DAILY_SQL, EVENT_SAMPLES_SQL

_c = F.col


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("k", "kind", "found", "quotes", "pairs", "parse", _c("is_shop").alias("shop"), F.concat(F.lit("P"), _c("k") % 4).alias("priority"), "country", "city", "is_phone", "is_named", "is_address", "v")


@query(f"WITH {_SQL} SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS rank FROM cases GROUP BY 1")
def a33_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.distribution(_channels(spark, sf_dir), "kind").withColumn("rank", _c("rank").cast("bigint"))


@query(f"WITH {_SQL} SELECT count(*) AS channels, count_if(quotes > 0) AS with_quotes, count_if(is_shop) AS shops, count_if(kind = 'market_price_channel') AS market_channels, count_if(parse >= 60) AS parseable FROM cases")
def a33_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.discovery_summary(_channels(spark, sf_dir))


@query(f"WITH {_SQL}, s AS (SELECT *, k % 4 IN (1, 2) AND quotes >= 3 AS strong FROM cases) SELECT count(*) AS channels, count_if(quotes >= 2) AS with_several, CAST(sum(quotes) AS BIGINT) AS quotes, CAST(sum(pairs) AS BIGINT) AS pairs, count_if(is_shop AND strong) AS strong_shops, count_if(kind IN ('dealer_network_channel', 'market_price_channel') AND strong) AS strong_networks, CASE WHEN sum(quotes) < 80 THEN 'few_dozen_signals' WHEN sum(quotes) < 250 THEN 'around_100_signals' ELSE 'several_hundred_signals' END AS universe FROM s")
def a34_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.signal_summary(_channels(spark, sf_dir))


@query(f"WITH {_SQL} SELECT count(*) AS new_sources, count(*) + 40 AS all_sources, count_if(found = 'exchange_shop') AS exchange_shop, 0::BIGINT AS regional_market_channel, count_if(found = 'settlement_exchange') AS settlement_exchange, count_if(parse >= 55 AND found IN ('exchange_shop', 'settlement_exchange')) AS publishable, CAST(sum(CASE WHEN parse >= 55 THEN greatest(1, least(quotes, 5) + pairs) END) AS BIGINT) AS records FROM cases")
def a35_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.multilingual_summary(_channels(spark, sf_dir).withColumn("kind", _c("found")), 40)


@query(f"WITH {_SQL} SELECT count(*) AS new, count_if(is_shop) AS shops, count_if(is_phone) AS rate_pages, count_if(is_named) AS social_feeds, count(*) + 7 AS all_sources FROM cases")
def a36_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.business_summary(_channels(spark, sf_dir).withColumns({"rate_page": _c("is_phone"), "social": _c("is_named")}), 7)


_REVIEWS = "v AS (SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'publishable' WHEN 1 THEN 'monitor_only' WHEN 2 THEN 'stale' ELSE 'no_usable_signal' END AS use, n_nationkey % 3 AS numeric, n_nationkey % 2 = 0 AS remittance, n_nationkey AS k FROM nation)"


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("n_nationkey")
    return table(spark, sf_dir, "nation").select(_c("n_name").alias("name"), F.when(k % 4 == 0, "publishable").when(k % 4 == 1, "monitor_only").when(k % 4 == 2, "stale").otherwise("no_usable_signal").alias("use"), (k % 3).alias("numeric"), (k % 2 == 0).alias("remittance"), k.alias("k"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), _c("c_nationkey") == _c("n_nationkey"))
    return c.select(_c("n_name").alias("name"), F.concat(F.lit("2024-01-"), F.lpad((1 + _c("c_custkey") % 28).cast("string"), 2, "0")).alias("at"), F.when(_c("c_custkey") % 10 == 0, "USD").when(_c("c_nationkey") % 3 == 0, "AED").otherwise("EUR").alias("currency"), (_c("c_nationkey") % 5 == 0).alias("remittance"), F.element_at(F.array(*[F.lit(x) for x in ("fresh", "recent", "stale", "odd")]), (1 + F.greatest(_c("c_custkey") % 2 + 1, _c("c_nationkey") % 4)).cast("int")).alias("freshness"))


@query(f"WITH {_REVIEWS} SELECT unnest(['publishable', 'monitor_only', 'stale', 'no_usable_signal', 'numeric', 'remittance']) AS list, unnest([list_sort(list(name) FILTER (WHERE k % 4 = 0)), list_sort(list(name) FILTER (WHERE k % 4 = 1)), list_sort(list(name) FILTER (WHERE k % 4 = 2)), list_sort(list(name) FILTER (WHERE k % 4 = 3)), list_sort(list(name) FILTER (WHERE k % 3 > 0)), list_sort(list(name) FILTER (WHERE k % 2 = 0))]) AS names, (SELECT count(*) FROM customer WHERE c_nationkey % 4 = 0) AS records FROM v")
def a38_review_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = surveys.review_summary(_reviews(spark, sf_dir), _records(spark, sf_dir))
    lists = ("publishable", "monitor_only", "stale", "no_usable_signal", "numeric", "remittance")
    return s.select(F.inline(F.array(*[F.struct(F.lit(n).alias("list"), F.array_join(n, "|").alias("names")) for n in lists])), "records").select("list", F.split("names", r"\|").alias("names"), "records")


@query(f"WITH {BASKET_SQL}, r AS (SELECT *, row_number() OVER () AS i FROM records) SELECT handle, concat('t', handle) AS title, min(CAST(basket AS INTEGER)) AS first, count(*) AS n, round(avg(quality), 2) AS quality, round(avg(freshness), 2) AS freshness FROM r GROUP BY 1")
def a31_channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = src.basket_records(spark, sf_dir).withColumns({"title": F.concat(F.lit("t"), "handle"), "locality": _c("basket").cast("int")})
    return surveys.contributions(r, "locality").select("handle", "title", _c("locality").alias("first"), "n", "quality", "freshness")


@query(f"WITH {_SQL} SELECT CASE WHEN tehran THEN 'Iran' WHEN dubai THEN 'UAE' WHEN herat THEN 'Afghanistan' WHEN country IN ('UAE', 'Iran', 'Turkey') THEN country END AS locality, count(*) AS n FROM cases WHERE is_named AND (tehran OR dubai OR herat OR country <> 'unknown') GROUP BY 1")
def a44_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = once(cases(spark, sf_dir), place=rules.place_of(_c("said"), F.lit(""), F.lit(""), F.lit("")))
    return surveys.remembered(c, _c("is_named"), [F.nullif("place", F.lit("unknown")), F.nullif("country", F.lit("unknown"))])


@query("SELECT n_name AS name, CASE WHEN min(f) = 1 THEN 'recent' WHEN min(f) = 2 THEN 'stale' ELSE 'none' END AS freshness FROM (SELECT n_name, greatest(c_custkey % 2 + 1, c_nationkey % 4) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def a46_best_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.best_freshness(_records(spark, sf_dir), "name", F.lit("none"))


@query("WITH f AS (SELECT c_nationkey AS l, list(DISTINCT concat('s', CAST(c_custkey % 7 AS VARCHAR))) AS ids FROM customer WHERE c_custkey % 40 BETWEEN 0 AND 30 AND c_nationkey < 20 GROUP BY 1), c AS (SELECT n_nationkey AS l, n_nationkey % 3 AS fresh, concat('s', CAST(n_nationkey % 9 AS VARCHAR)) AS s FROM nation) SELECT CAST(c.l AS VARCHAR) AS locality, CASE WHEN fresh > 0 THEN fresh WHEN list_contains(ids, s) THEN 1 ELSE 0 END AS fresh_count, CASE WHEN fresh = 0 AND list_contains(ids, s) THEN [s] ELSE [] END AS fresh_sources FROM c LEFT JOIN f ON c.l = f.l")
def j16_fresh_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards without fresh sources, beside what the registry saw in 30 hours (Y48)."""
    now = F.lit("2024-02-01").cast("timestamp")
    s = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(_c("c_nationkey").cast("string").alias("locality"), F.concat(F.lit("s"), _c("c_custkey") % 7).alias("id"), (now - F.make_dt_interval(F.lit(0), (_c("c_custkey") % 40).cast("int"))).alias("seen"))
    k = _c("n_nationkey")
    cards = table(spark, sf_dir, "nation").select(k.cast("string").alias("locality"), F.array(F.lit("x"), F.concat(F.lit("s"), k % 9)).alias("sources"), (k % 3).alias("fresh_count"), F.array().cast("array<string>").alias("fresh_sources"))
    return surveys.fresh_fallback(cards, surveys.fresh_ids(s, now)).select("locality", _c("fresh_count").cast("int").alias("fresh_count"), "fresh_sources")


@query("""SELECT concat('h', CAST(n_nationkey AS VARCHAR)) AS handle, CASE WHEN n_nationkey >= 20 THEN 'more' WHEN n_nationkey >= 8 AND n_nationkey % 3 = 0 THEN 'more' WHEN n_nationkey % 3 = 0 THEN concat('h', CAST(n_nationkey AS VARCHAR)) ELSE n_name END AS title,
    CASE WHEN n_nationkey >= 20 THEN 'exchange_shop' WHEN n_nationkey >= 8 AND n_nationkey % 2 = 0 THEN 'exchange_shop' WHEN n_nationkey % 2 = 0 THEN 'unknown' ELSE 'board' END AS kind, CASE WHEN n_nationkey >= 20 THEN 12.0 WHEN n_nationkey >= 8 THEN greatest(12.0, n_nationkey) ELSE n_nationkey END::DOUBLE AS density FROM nation""")
def j19_merge_richer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, handle = _c("n_nationkey"), F.concat(F.lit("h"), _c("n_nationkey"))
    n = table(spark, sf_dir, "nation")
    ours = n.where("n_nationkey < 20").select(handle.alias("handle"), F.when(k % 3 == 0, handle).otherwise(_c("n_name")).alias("title"), F.when(k % 2 == 0, "unknown").otherwise("board").alias("kind"), k.cast("double").alias("density"), F.concat(F.lit("x/"), handle).alias("url"))
    extra = n.where("n_nationkey >= 8").select(handle.alias("handle"), F.lit("more").alias("title"), F.lit("exchange_shop").alias("kind"), F.lit(12.0).alias("density"), F.lit("y").alias("url"))
    return surveys.merge_richer(ours, extra).select("handle", "title", "kind", "density")


@query("""WITH b AS (SELECT c_custkey AS i, c_nationkey AS key, repeat('n', CAST(c_custkey % 9 AS INTEGER)) AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS website, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE concat('c', CAST(c_custkey AS VARCHAR)) END AS country, c_custkey % 50 = 0 AS shop, c_acctbal AS score FROM customer)
    SELECT CAST(key AS VARCHAR) AS key, max(length(name)) AS name_length, coalesce(arg_min(website, i) FILTER (WHERE website <> ''), '') AS website, coalesce(arg_min(country, i) FILTER (WHERE country <> 'unknown'), 'unknown') AS country, bool_or(shop) AS shop, max(score) AS score, 'a|b|c' AS origins FROM b GROUP BY key""")
def u7_merge_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("c_custkey")
    b = table(spark, sf_dir, "customer").select(k.alias("i"), _c("c_nationkey").cast("string").alias("g"), F.repeat(F.lit("n"), (k % 9).cast("int")).alias("name"), F.when(k % 4 != 0, k.cast("string")).otherwise("").alias("website"), F.when(k % 3 == 0, "unknown").otherwise(F.concat(F.lit("c"), k)).alias("country"), F.lit("unknown").alias("kind"), (k % 50 == 0).alias("shop"), _c("c_acctbal").alias("score"), F.when(k % 2 == 0, "b|a").otherwise("|c").alias("origins"))
    return surveys.merge_businesses(b, _c("g"), "i").select("key", F.length("name").cast("bigint").alias("name_length"), "website", "country", "shop", "score", "origins")


@query(f"WITH {_SQL} SELECT concat('chan_', CAST(k AS VARCHAR)) AS handle, kind, origin FROM (SELECT k, kind, 'existing_registry' AS origin FROM cases WHERE kind IN ('dealer_network_channel', 'market_price_channel', 'aggregator') AND (tehran OR herat) AND NOT is_phone UNION ALL SELECT k, CASE WHEN is_named THEN 'regional_market_channel' ELSE kind END, 'previous_candidate_registry' FROM cases WHERE (quotes > 0 OR pairs > 0) AND NOT is_address)")
def y34_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a survey and of earlier candidates (Y35)."""
    c = cases(spark, sf_dir).withColumns({"handle": F.concat(F.lit(" Chan_"), "k"), "url": F.when(_c("is_phone"), "").otherwise("u")})
    hits = F.filter(F.array(F.lit("tehran"), F.lit("herat")), lambda w: F.contains(_c("said"), w))
    earlier = c.select(F.when(_c("is_address"), F.concat(F.lit("no "), "k")).otherwise(_c("handle")).alias("handle"), "quotes", _c("pairs").alias("boards"), F.when(_c("is_named"), " ").otherwise(_c("kind")).alias("kind"))
    return surveys.seeds_of_survey(c, hits).unionByName(surveys.seeds_of_candidates(earlier))


@query(f"WITH {_SQL} SELECT concat('h', CAST(k AS VARCHAR)) AS handle, CASE WHEN is_named THEN 'regional_fx_board' ELSE 'unknown' END AS kind, score * 1.0 AS density FROM cases WHERE is_hint OR (is_named AND (pairs > 0 OR places >= 2)) OR k % 100 = 7 UNION ALL SELECT 'only_there', 'regional_market_channel', 70.0")
def f19_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).select(F.concat(F.lit("H"), "k").alias("handle"), F.when(_c("is_named"), "regional_fx_board").otherwise("unknown").alias("kind"), _c("score").cast("double").alias("density"), _c("pairs").alias("boards"), "places", "is_hint", "k")
    there = c.where("k % 100 = 7").select("handle").unionByName(spark.sql("SELECT ' Only_There ' AS handle"))
    return surveys.select_candidates(c, _c("is_hint"), there)


@query("SELECT n_name AS handle, coalesce(n, 0) AS usable, CASE WHEN n IS NULL THEN ['m'] ELSE list_sort(list_distinct(list_concat(l, ['m']))) END AS localities FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, list(DISTINCT concat('l', CAST(s_suppkey % 4 AS VARCHAR))) AS l FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def y37_registry_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    records = table(spark, sf_dir, "supplier").join(n, _c("s_nationkey") == _c("n_nationkey")).select(_c("n_name").alias("handle"), F.concat(F.lit("l"), _c("s_suppkey") % 4).alias("locality"))
    return surveys.registry_updates(n.select(_c("n_name").alias("handle"), F.array(F.lit("m")).alias("mentions")), records)


@query("SELECT n_name AS name, greatest('2024-01-10', concat('2024-01-', lpad(CAST(max(1 + c_custkey % 28) AS VARCHAR), 2, '0'))) AS last_seen, CASE WHEN bool_or(c_custkey % 10 = 0) AND bool_or(c_custkey % 10 > 0 AND c_nationkey % 3 = 0) THEN 'website_rate_board' WHEN bool_or(c_nationkey % 5 = 0) THEN 'remittance_quote' WHEN bool_or(c_custkey % 10 = 0) OR bool_or(c_nationkey % 3 = 0) THEN 'numeric_quote_page' ELSE 'stale_public_signal' END AS signal FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 4 = 2 GROUP BY 1")
def f23_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reviews(spark, sf_dir).withColumn("freshness", F.lit("stale"))
    w = surveys.watchlist(r, r.select("name", F.lit("2024-01-10").alias("last_seen")), _records(spark, sf_dir))
    return w.select("name", "last_seen", rules.watch_signal(_c("usd"), _c("aed"), _c("remit")).alias("signal"))


@query(f"WITH {DAILY_SQL} SELECT day, CASE WHEN day >= DATE '1999-01-01' AND fix > 100000 THEN fix + 1 ELSE fix END AS value FROM daily WHERE key = '1-URGENT'")
def u2_day_files_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.daily_values(spark, sf_dir).where("key = '1-URGENT'").select("day", _c("fix").alias("value"))
    own = d.where("day >= DATE'1999-01-01'").withColumn("value", F.when(_c("value") > 100_000, _c("value") + 1))
    return surveys.day_files_over_series(own, d)


@query(f"WITH {DAILY_SQL} SELECT DISTINCT day, CASE WHEN day(day) % 3 = 1 THEN 'old' END AS fingerprint FROM daily WHERE day(day) % 3 < 2")
def u11_stale_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.dayofmonth("day") % 3
    days = src.daily_values(spark, sf_dir).select("day").distinct().withColumn("fingerprint", F.when(m == 1, "old").when(m == 2, "now"))
    return surveys.stale_mappings(days, "now")


@query(f"WITH {EVENT_SAMPLES_SQL}, s AS (SELECT day, source, bool_or(ok AND NOT stale AND value > 60) AS included FROM samples GROUP BY 1, 2) SELECT day, list_sort(coalesce(list(source) FILTER (WHERE included), [])) AS eligible, list_sort(coalesce(list(source) FILTER (WHERE NOT included), [])) AS excluded, count_if(included) AS source_count FROM s GROUP BY 1")
def y13_daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.event_samples(spark, sf_dir).groupBy("day", "source").agg(F.bool_or(_c("ok") & ~_c("stale") & (_c("value") > 60)).alias("included"))
    return surveys.daily_history(s)


@query("SELECT c_custkey, CASE WHEN c_nationkey < 12 AND c_acctbal > 0 THEN 'open_market' WHEN c_custkey % 2 = 0 THEN 'official' WHEN c_acctbal > 5000 THEN 'crypto_usdt' END AS benchmark FROM customer")
def f10_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.create_map(F.lit("official"), F.when(_c("c_custkey") % 2 == 0, 1.0), F.lit("open_market"), "c_acctbal", F.lit("crypto_usdt"), _c("c_acctbal") - 5000)
    families = F.array_compact(F.array(F.lit("official"), F.lit("crypto_usdt"), F.when(_c("c_nationkey") < 12, "open_market")))
    return table(spark, sf_dir, "customer").select("c_custkey", surveys.representative(values, families).alias("benchmark"))


@query(f"WITH {BASKET_SQL}, p AS (SELECT basket, handle, sum(quality) AS w FROM records GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY w DESC, handle) AS i FROM p) SELECT basket, list(handle ORDER BY i) AS top FROM k WHERE i <= 3 GROUP BY 1")
def o5_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.top_sources(src.basket_records(spark, sf_dir), "basket", "handle", "quality")


@query("SELECT c_nationkey, concat(k, ':', url) AS surface FROM (SELECT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'web' ELSE 'chat' END AS k, CAST(c_custkey AS VARCHAR) AS url, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13 DESC, c_custkey % 7 DESC, CASE WHEN c_custkey % 2 = 0 THEN 'web' ELSE 'chat' END DESC, CAST(c_custkey AS VARCHAR) DESC) AS i FROM customer) WHERE i = 1")
def o9_primary_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("c_custkey")
    s = table(spark, sf_dir, "customer").select("c_nationkey", F.when(k % 2 == 0, "web").otherwise("chat").alias("kind"), k.cast("string").alias("url"), (k % 13).alias("usable"), (k % 7).alias("score"))
    return surveys.primary_surface(s, "c_nationkey")


@query(f"WITH {DAILY_SQL}, w AS (SELECT day, max(CASE WHEN key = '1-URGENT' THEN fix END) AS s, max(CASE WHEN key = '2-HIGH' THEN fix END) AS o FROM daily GROUP BY 1), g AS (SELECT day, CASE WHEN day(day) % 5 = 0 THEN NULL WHEN day(day) % 3 = 0 THEN 1.5 ELSE (s - o) / o * 100 END AS gap FROM w) SELECT day, round(gap, 6) AS gap FROM g WHERE gap IS NOT NULL")
def y2_gap_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of all days (Y1): stored, else recomputed, none of days that are withheld."""
    d = src.daily_values(spark, sf_dir).groupBy("day").agg(F.max(F.when(_c("key") == "1-URGENT", _c("fix"))).alias("s"), F.max(F.when(_c("key") == "2-HIGH", _c("fix"))).alias("o"))
    m = F.dayofmonth("day")
    gap = publish.gap_value(F.when(m % 3 == 0, 1.5), _c("s"), _c("o"), m % 5 == 0)
    return d.select("day", F.round(gap, 6).alias("gap")).where("gap IS NOT NULL")


@query("SELECT CAST(o_orderdate AS DATE) AS day, max(o_orderdate) AS at, arg_max(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 10000000 + o_orderkey) AS k FROM orders GROUP BY 1")
def k6_latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), _c("o_orderdate").alias("at"), _c("o_orderkey").alias("k"))
    return surveys.latest_attempt(o)


@query("SELECT p_partkey, p_brand FROM part ORDER BY p_brand, p_partkey LIMIT 40")
def o6_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.capped(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [_c("p_brand"), _c("p_partkey")], 40)


@query("SELECT min(c_custkey) AS c_custkey, lower(c_mktsegment) AS q FROM customer GROUP BY 2")
def y66_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select("c_custkey", F.when(_c("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("q"))
    return surveys.query_plan(q, F.lower(F.trim("q")), "c_custkey").select("c_custkey", F.lower(F.trim("q")).alias("q"))


@query(f"WITH {_SQL} SELECT list_sort(list(DISTINCT concat('s', CAST(k % 30 AS VARCHAR))) FILTER (WHERE k % 30 < 20)) AS eligible, list_sort(list(DISTINCT concat('s', CAST(k % 30 AS VARCHAR))) FILTER (WHERE k % 30 >= 20)) AS diagnostic_only FROM cases")
def y14_by_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _c("k") % 30
    return surveys.by_eligibility(cases(spark, sf_dir).select(F.concat(F.lit("s"), m).alias("source"), F.when(m < 20, True).when(m < 25, False).alias("eligible")))


@query(f"WITH {DAILY_SQL}, d AS (SELECT day, fix, lag(fix) OVER (ORDER BY day) AS b FROM daily WHERE key = '1-URGENT') SELECT day, fix, CASE WHEN day(day) % 2 = 0 THEN 9 ELSE 4 END AS used, CASE WHEN day(day) % 3 = 0 THEN 1.0 ELSE b END AS previous_fix, round(fix - b, 4) AS delta, fix = b AS same FROM d")
def y5_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.dayofmonth("day")
    d = src.daily_values(spark, sf_dir).where("key = '1-URGENT'").select("day", "fix", F.lit(4).alias("n_sources"), F.when(m % 2 == 0, 9).alias("used"), F.when(m % 3 == 0, 1.0).alias("previous_fix"), F.lit(None).cast("double").alias("delta"), F.lit(None).cast("boolean").alias("same"))
    return surveys.with_selection(d).withColumn("delta", F.round("delta", 4))


@query(f"WITH {_SQL} SELECT concat('chan_', CAST(k AS VARCHAR)) AS handle, CASE WHEN is_hint THEN 'regional_market_channel' ELSE kind END AS kind FROM cases WHERE is_named AND (is_phone OR is_address) AND (is_mapped OR pairs > 0) AND k % 10 <> 4")
def y36_registry_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a registry's useful sources of some families (F17)."""
    c = cases(spark, sf_dir)
    families = F.concat_ws(" | ", F.when(_c("is_phone"), "regional_fx_board"), F.when(_c("is_address"), "direct_shop_expansion"), F.lit("other"))
    ours = c.where(rules.active_source(F.when(_c("is_named"), "Telegram").otherwise("web"), families, F.when(_c("is_mapped"), "2024").otherwise(""), _c("pairs"), "telegram", ("regional_fx_board", "regional_market_signal", "direct_shop_expansion")))
    return surveys.seeds_of_registry(ours.select(F.when(_c("k") % 10 == 4, "x-y").otherwise(F.concat(F.lit("Chan_"), "k")).alias("handle"), F.when(_c("is_hint"), "").otherwise(_c("kind")).alias("kind")))
