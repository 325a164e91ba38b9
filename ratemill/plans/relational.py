"""Queries of joins, aggregates, sets, rankings and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratemill.functions import stats
from ratemill.operators import dedup, fix, registry, robust
from ratemill.plans.registry import QUERIES, query, table
from ratemill.session import shared_folder
from ratemill.sources import samples as src
from ratemill.sources.samples import BASKET_SQL, DAILY_SQL, EVENT_SAMPLES_SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(name: str, what: str, sql: str) -> None:
    """A query that is the same text in both dialects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
        return spark.sql(sql, **named)

    run.__name__, run.__doc__ = name, what
    assert name not in QUERIES
    query(sql.format(**{t: t for t in TABLES}))(run)


plain("j1_dim_lookup", "Left join with a small dimension of unique keys.", "SELECT c.c_custkey, n.n_name, c.c_acctbal FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey")
plain("j2_star", "Left star of three dimensions.", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey")
plain("j3_inner", "Records whose channel exists.", "SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE s.s_acctbal > 0")
plain("j8_semi", "Samples of sources in the family.", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_suppkey IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 5000)")
plain("j10_anti", "Candidates that nothing known matches.", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
plain("j11_anti_text", "Documents whose text is no benchmark item.", "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {benchmark} b WHERE b.text = d.text)")
plain("j18_default_join", "Every nation with its suppliers, zero where it has none.", "SELECT n.n_nationkey, n.n_name, count(s.s_suppkey) AS suppliers, coalesce(round(sum(s.s_acctbal), 2), 0.0) AS balance FROM {nation} n LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 2000 GROUP BY n.n_nationkey, n.n_name")
plain("a24_region_summary", "Regions with zero fill.", "SELECT r.r_name, count(c.c_custkey) AS n, count(DISTINCT c.c_mktsegment) AS channels FROM {region} r LEFT JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY r.r_name")
plain("a28_baseline_counts", "Counts per locality.", "SELECT n.n_regionkey AS locality, count(*) AS n FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_regionkey")
plain("a30_category_mix", "Histogram of categories.", "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand")
plain("a31_contributions", "Rows per channel.", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 4) AS quality, round(avg(l_discount), 6) AS freshness FROM {lineitem} GROUP BY l_suppkey")
plain("a33_discovery_summary", "Counts by kind and day, the most frequent first.", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type ORDER BY n DESC, event_type")
plain("a34_bucket_summary", "Values by bucket.", "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1")
plain("a39_state_counts", "Orders by status.", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
plain("a42_capped_sum", "A sum of capped points per segment.", "SELECT c_mktsegment, sum(least(15, c_custkey % 40)) AS points FROM {customer} GROUP BY c_mktsegment")
plain("o3_top_20", "The twenty dearest parts.", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
plain("o2_top_5_each", "Five suppliers of each nation.", "SELECT s_nationkey, s_suppkey, k FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM {supplier}) WHERE k <= 5")
plain("u1_union_all", "Three streams in one.", "SELECT c_custkey AS k, c_acctbal AS v, 'c' AS origin FROM {customer} UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM {supplier} UNION ALL SELECT p_partkey, p_retailprice, 'p' FROM {part}")
plain("u8_common_days", "Days of both kinds.", "SELECT CAST(ts AS DATE) AS day FROM {events} WHERE event_type = 'signup' INTERSECT SELECT CAST(ts AS DATE) FROM {events} WHERE event_type = 'purchase'")
plain("u9_difference", "Nations without suppliers above a balance.", "SELECT n_nationkey FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000")
plain("w11_shares", "Share of the total and of the group.", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 8) AS share FROM {customer} WHERE c_acctbal > 0")
plain("w16_nearest", "The customer nearest to its nation's mean.", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - m), c_custkey) AS k FROM (SELECT c_nationkey, c_custkey, c_acctbal, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS m FROM {customer})) WHERE k = 1")
plain("y11_ok_counts", "Good and all samples per source.", "SELECT user_id % 6 AS source, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS ok, count(*) AS total FROM {events} GROUP BY 1")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def o1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite ranking over all rows, of which no task sees more than a bucket's."""
    return dedup.rank_all(table(spark, sf_dir, "supplier"), "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], "rank").select("s_suppkey", F.col("rank").cast("int").alias("rank"))


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def a29_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return p.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1")
def a43_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"), F.count_distinct("p_size").alias("sizes"))


@query("WITH x AS (SELECT c_custkey, unnest(string_split(lower(replace(c_name, '#', ' ')), ' ')) AS family FROM customer) SELECT family, count(*) AS n FROM x WHERE length(family) < 9 GROUP BY 1")
def a32_exploded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select(F.explode(F.split(F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))), " ")).alias("family"))
    return x.where(F.length("family") < 9).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, arg_max(event_id, value * 1000000 + event_id) AS best, count(*) AS n FROM events GROUP BY 1")
def o4_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {BASKET_SQL}, r AS (SELECT basket, handle, max(freshness) AS f FROM records GROUP BY 1, 2) SELECT basket, count_if(f >= 85) AS fresh, string_agg(CASE WHEN f >= 85 THEN handle END, ',' ORDER BY handle) AS names FROM r GROUP BY 1")
def w12_fresh_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = src.basket_records(spark, sf_dir).groupBy("basket", "handle").agg(F.max("freshness").alias("f"))
    return r.groupBy("basket").agg(F.count_if(F.col("f") >= 85).alias("fresh"), F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("f") >= 85, F.col("handle")))), ","), F.lit("")).alias("names"))


_RESEARCH = """c1 AS (SELECT *, count(*) OVER (PARTITION BY basket) AS n, quantile_cont(rate, 0.5) OVER (PARTITION BY basket) AS med, quantile_cont(rate, 0.05) OVER (PARTITION BY basket) AS p05, quantile_cont(rate, 0.95) OVER (PARTITION BY basket) AS p95 FROM records),
    c2 AS (SELECT *, quantile_cont(abs(rate - med), 0.5) OVER (PARTITION BY basket) AS mad FROM c1), c3 AS (SELECT *, n >= {n} AND (CASE WHEN mad > 0 THEN 0.6745 * abs(rate - med) / mad ELSE 0 END > 3.5 OR rate < p05 OR rate > p95) AS outlier FROM c2)"""


@query(f"WITH {BASKET_SQL}, {_RESEARCH.format(n=8)} SELECT basket, handle, rate, outlier FROM c3")
def w10b_research_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.outliers_research(src.basket_records(spark, sf_dir), ["basket"], "rate", 8).select("basket", "handle", "rate", "outlier")


@query(f"WITH {BASKET_SQL}, c1 AS (SELECT *, count(*) OVER (PARTITION BY basket) AS n, quantile_cont(rate, 0.5) OVER (PARTITION BY basket) AS med FROM records), c2 AS (SELECT *, quantile_cont(abs(rate - med), 0.5) OVER (PARTITION BY basket) AS mad FROM c1) SELECT basket, handle, rate, round(CASE WHEN n >= 3 AND mad <> 0 THEN 0.6745 * (rate - med) / mad END, 8) AS modified_z, coalesce(n >= 3 AND mad <> 0 AND abs(0.6745 * (rate - med) / mad) > 3.5, FALSE) AS outlier FROM c2")
def w10a_model_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.outliers_model(src.basket_records(spark, sf_dir), ["basket"], "rate").select("basket", "handle", "rate", F.round("modified_z", 8).alias("modified_z"), "outlier")


@query(f"""WITH {BASKET_SQL}, {_RESEARCH.format(n=5)}, k AS (SELECT *, row_number() OVER (PARTITION BY basket ORDER BY rate) AS i, count(*) OVER (PARTITION BY basket) AS m FROM c3 WHERE NOT outlier)
    SELECT basket, round(quantile_cont(rate, 0.5), 4) AS median, round(avg(rate) FILTER (WHERE m <= 2 OR (i > floor(m * 0.1) AND i <= m - floor(m * 0.1))), 4) AS trimmed, round(sum(rate * quality) / sum(quality), 4) AS weighted, round(quantile_cont(CASE WHEN category = 'direct_shop' THEN rate END, 0.5), 4) AS direct_only FROM k GROUP BY 1""")
def a18_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("rate")
    clean = robust.outliers_research(src.basket_records(spark, sf_dir), ["basket"], "rate").where("NOT outlier")
    trims = robust.trimmed_mean(clean, ["basket"], "rate", "research").withColumn("trimmed", F.round("trimmed", 4))
    return robust.joined(trims, clean.groupBy("basket").agg(
        F.round(stats.median(v), 4).alias("median"), F.round(stats.weighted_mean(v, F.col("quality")), 4).alias("weighted"), F.round(stats.median(F.when(F.col("category") == "direct_shop", v)), 4).alias("direct_only"),
    ), ["basket"])


@query(f"WITH {DAILY_SQL} SELECT day, key, CASE WHEN day >= DATE '1999-01-01' THEN fix + 1 ELSE fix END AS fix FROM daily WHERE day >= DATE '1998-01-01'")
def u3_history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.daily_values(spark, sf_dir).where("day >= DATE'1998-01-01'")
    new = d.where("day >= DATE'1999-01-01'").withColumn("fix", F.col("fix") + 1)
    return dedup.upsert(d, new, ["day", "key"])


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, event_id DESC) AS k FROM events) SELECT user_id, event_id, CASE WHEN value > 50 THEN value END AS v FROM r WHERE k = 1")
def u4_better_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value")))
    return dedup.upsert_newest(e, ["user_id"], "v", "event_id").select("user_id", "event_id", "v")


@query("""WITH f AS (SELECT s_nationkey AS k, s_name AS name, CASE WHEN s_acctbal > 3000 THEN concat('w', CAST(s_suppkey AS VARCHAR)) END AS website, s_acctbal > 8000 AS has_rate, s_suppkey % 7 AS posts, s_acctbal AS points, s_suppkey AS i FROM supplier)
    SELECT k, arg_max(name, length(name) * 1000000 - i) AS name, arg_min(website, i) FILTER (WHERE website IS NOT NULL) AS website, bool_or(has_rate) AS has_rate, max(posts) AS posts, max(points) AS points, string_agg(DISTINCT CAST(posts AS VARCHAR), '|' ORDER BY CAST(posts AS VARCHAR)) AS origins FROM f GROUP BY 1""")
def u6_merge_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    f = s.select(
        F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("w"), "s_suppkey")).alias("website"), (F.col("s_acctbal") > 8000).alias("has_rate"), (F.col("s_suppkey") % 7).alias("posts"), F.col("s_acctbal").alias("points"),
        F.array((F.col("s_suppkey") % 7).cast("string")).alias("origins"), F.col("s_suppkey").alias("i"),
    )
    return registry.merge_found(f, "k", "i").withColumn("origins", F.array_join("origins", "|"))


@query("""WITH r AS (SELECT concat('k', CAST(c_custkey AS VARCHAR)) AS key, c_name AS title, c_mktsegment AS status, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE CAST(c_nationkey AS VARCHAR) END AS country, c_custkey % 9 AS q FROM customer WHERE c_custkey % 2 = 0),
    u AS (SELECT concat('k', CAST(c_custkey AS VARCHAR)) AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(c_name, '!') END AS title, CAST(c_nationkey + 100 AS VARCHAR) AS country, c_custkey % 11 AS q FROM customer WHERE c_custkey % 4 <> 1)
    SELECT coalesce(r.key, u.key) AS key, coalesce(nullif(u.title, ''), r.title) AS title, coalesce(CASE WHEN r.country <> 'unknown' THEN r.country END, u.country, 'unknown') AS country, coalesce(u.q, r.q) AS last_q, greatest(r.q, u.q) AS best_q, coalesce(CASE WHEN r.key IS NOT NULL THEN DATE '2024-01-01' END, DATE '2024-02-01') AS first_seen, CASE WHEN u.key IS NOT NULL THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS last_seen FROM r FULL JOIN u ON r.key = u.key""")
def j15_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, words = F.concat(F.lit("k"), "c_custkey").alias("key"), lambda x: F.array(x.cast("string"))
    k = F.col("c_custkey")
    old = F.lit("2024-01-01").cast("date")
    reg = c.where(k % 2 == 0).select(
        key, F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.when(k % 3 == 0, "unknown").otherwise(F.col("c_nationkey").cast("string")).alias("country"), *[words(k % 3).alias(s) for s in registry.SETS],
        *[(k % 9).alias(f"{p}_{n}") for n in registry.COUNTS for p in ("last", "best")], old.alias("first_seen"), old.alias("last_seen"), old.alias("last_success"),
    )
    upd = c.where(k % 4 != 1).select(key, F.when(k % 5 == 0, "").otherwise(F.concat("c_name", F.lit("!"))).alias("title"), F.lit("").alias("status"), (F.col("c_nationkey") + 100).cast("string").alias("country"), *[words(k % 4).alias(s) for s in registry.SETS], *[(k % 11).alias(n) for n in registry.COUNTS])
    out = registry.upsert(reg, upd, F.lit("2024-02-01").cast("date"))
    return out.select("key", "title", "country", F.col("last_usable_record_count").alias("last_q"), F.col("best_usable_record_count").alias("best_q"), "first_seen", "last_seen")


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, s_suppkey % 40 AS name, s_suppkey % 33 AS domain, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 21 END AS handle, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS i FROM supplier WHERE s_suppkey % 40 NOT BETWEEN 0 AND 4 AND NOT coalesce(s_suppkey % 3 = 0 AND s_suppkey % 21 BETWEEN 0 AND 4, FALSE)),
    o AS (SELECT * REPLACE (row_number() OVER (ORDER BY i) AS i) FROM s), g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS n, []::BIGINT[] AS d, []::BIGINT[] AS h, FALSE AS ok
        UNION ALL SELECT i, CASE WHEN ok THEN list_append(n, name) ELSE n END, CASE WHEN ok THEN list_append(d, domain) ELSE d END, CASE WHEN ok AND handle IS NOT NULL THEN list_append(h, handle) ELSE h END, ok
        FROM (SELECT o.i, g.n, g.d, g.h, o.name, o.domain, o.handle, NOT list_contains(g.n, o.name) AND NOT list_contains(g.d, o.domain) AND NOT coalesce(list_contains(g.h, o.handle), FALSE) AS ok FROM g JOIN o ON o.i = g.i + 1))
    SELECT s_suppkey, name, domain, handle, s_acctbal FROM o JOIN g USING (i) WHERE ok""")
def j9_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as found businesses, customers of the first nations as known ones, by three keys."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40).alias("name"), (F.col("s_suppkey") % 33).alias("domain"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 21).alias("handle"), "s_acctbal")
    known = table(spark, sf_dir, "customer").where("c_custkey < 5").select(F.col("c_custkey").alias("name"), F.lit(None).cast("bigint").alias("domain"), F.col("c_custkey").alias("handle"))
    shared_folder(spark)
    return registry.new_only(s, known, ["name", "domain", "handle"], [-F.col("s_acctbal"), F.col("s_suppkey")])


_CARD_SQL = """c AS (SELECT CAST(s_nationkey AS VARCHAR) AS locality, CASE s_suppkey % 4 WHEN 0 THEN 'hide' WHEN 1 THEN 'monitor' ELSE 'publish' END AS state, s_acctbal + 5000 AS rate, CASE s_suppkey % 3 WHEN 0 THEN 'enriched' WHEN 1 THEN 'board' ELSE 'legacy' END AS artifact, s_suppkey % 60 AS usable, s_suppkey % 7 AS sources, s_suppkey % 5 AS fresh, CAST(40 + s_suppkey % 50 AS DOUBLE) AS confidence FROM supplier)"""


@query(f"""WITH {_CARD_SQL}, w AS (SELECT *, state = 'publish' AND rate IS NOT NULL AS good, greatest(least(usable, 250), sources * 8, 1) * greatest(0.35, least(1.0, confidence / 100)) AS w FROM c),
    b AS (SELECT *, row_number() OVER (PARTITION BY locality ORDER BY CASE state WHEN 'publish' THEN 3 WHEN 'monitor' THEN 2 ELSE 1 END DESC, fresh DESC, sources DESC, usable DESC, CASE artifact WHEN 'enriched' THEN 3 WHEN 'board' THEN 2 ELSE 1 END DESC, confidence DESC) AS k FROM w),
    p AS (SELECT locality, count_if(good) AS n, max(rate) FILTER (WHERE good) / min(rate) FILTER (WHERE good) AS ratio, sum(rate * w) FILTER (WHERE good) / sum(w) FILTER (WHERE good) AS r, sum(confidence * w) FILTER (WHERE good) / sum(w) FILTER (WHERE good) AS cf, CAST(sum(usable) FILTER (WHERE good) AS BIGINT) AS u FROM w GROUP BY 1)
    SELECT p.locality, CASE WHEN m THEN 'publish' ELSE b.state END AS state, CASE WHEN m THEN 'merged_diagnostics' ELSE b.artifact END AS artifact, round(CASE WHEN m THEN r ELSE b.rate END, 4) AS rate, round(CASE WHEN m THEN cf ELSE b.confidence END, 6) AS confidence, CASE WHEN m THEN u ELSE b.usable END AS usable
    FROM (SELECT *, coalesce(n >= 2 AND ratio <= 3.0, FALSE) AS m FROM p) p JOIN b ON b.locality = p.locality AND b.k = 1""")
def a39b_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equally good candidates, which the SQL leaves open, the one of the smallest key."""
    return registry.cards(_candidates(spark, sf_dir), 3.0, "s_suppkey").withColumns({"rate": F.round("rate", 4), "confidence": F.round("confidence", 6)})


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("s_suppkey"), F.col("s_nationkey").cast("string").alias("locality"), F.when(k % 4 == 0, "hide").when(k % 4 == 1, "monitor").otherwise("publish").alias("state"), (F.col("s_acctbal") + 5000).alias("rate"), F.when(k % 3 == 0, "enriched").when(k % 3 == 1, "board").otherwise("legacy").alias("artifact"),
        (k % 60).alias("usable"), (k % 7).alias("sources"), (k % 5).alias("fresh"), (40 + k % 50).cast("double").alias("confidence"),
    )


@query("""WITH r AS (SELECT ts, event_type AS locality, value AS rate, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC) = 1 AS last FROM events)
    SELECT locality, count(*) AS point_count, count_if(last) AS daily_count, arg_max(rate, ts) AS latest_rate, round(sum(rate) FILTER (WHERE last), 4) AS daily_sum FROM r GROUP BY 1""")
def w7b_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("locality"), F.col("value").alias("rate"))
    t = registry.timeseries(e)
    return t.select("locality", "point_count", "daily_count", "latest_rate", F.round(F.aggregate("daily", F.lit(0.0), lambda s, x: s + x["rate"]), 4).alias("daily_sum"))


@query(f"""WITH {EVENT_SAMPLES_SQL}, a AS (SELECT day, round(avg(value), 6) AS street FROM samples WHERE benchmark = 'open_market' GROUP BY 1), b AS (SELECT day, round(avg(value), 6) AS peer FROM samples WHERE benchmark = 'official' GROUP BY 1)
    SELECT day, round(street - peer, 6) AS spread, concat_ws(',', CASE WHEN peer > street * 1.05 THEN 'official_above_street' END, CASE WHEN peer / street < 0.3 OR peer / street > 1.3 THEN 'official_outside_band' END) AS warnings FROM a JOIN b USING (day)""")
def j4_spread_and_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.event_samples(spark, sf_dir)
    a = s.where("benchmark = 'open_market'").groupBy("day").agg(F.round(F.avg("value"), 6).alias("street"))
    b = s.where("benchmark = 'official'").groupBy("day").agg(F.round(F.avg("value"), 6).alias("peer"))
    return a.join(b, "day").select("day", F.round(F.col("street") - F.col("peer"), 6).alias("spread"), F.array_join(fix.sanity_warnings(F.col("street"), F.col("peer")), ",").alias("warnings"))


@query("WITH a AS (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY 1) SELECT x.k AS left_key, y.k AS right_key, round(x.m - y.m, 4) AS spread FROM a x JOIN a y ON y.k = x.k + 1")
def j14_pair_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(stats.median(F.col("c_acctbal")).alias("m"))
    return a.alias("x").join(a.alias("y"), F.col("y.k") == F.col("x.k") + 1).select(F.col("x.k").alias("left_key"), F.col("y.k").alias("right_key"), F.round(F.col("x.m") - F.col("y.m"), 4).alias("spread"))


@query("SELECT n.n_nationkey, n.n_name, coalesce(string_agg(s.s_name, '|' ORDER BY s.s_suppkey), '') AS names, count(s.s_suppkey) AS n FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY 1, 2")
def j12_left_with_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("l"))
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce(F.array_join(F.col("l.s_name"), "|"), F.lit("")).alias("names"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n"))


@query("WITH m AS (SELECT conv_id, turn, role FROM conversations), k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i, role FROM conversations) SELECT m.conv_id, m.turn, k.text AS first_text FROM m LEFT JOIN k ON m.conv_id = k.conv_id AND m.role = k.role AND k.i = 1")
def j17_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations")
    first = F.first("text").over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return m.select("conv_id", "turn", first.alias("first_text"))


@query("SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_brand LIKE '%1' THEN 'first' END) AS notes FROM part")
def y20_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("; ", F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 1500, "dear"), F.when(F.col("p_brand").endswith("1"), "first")).alias("notes"))
