"""Queries of text functions, quote records, dedup and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import labels, numbers, text, times
from ratemill.operators import dedup, quotes
from ratemill.plans.registry import query, table
from ratemill.sources import samples as src
from ratemill.sources.samples import MESSAGES_SQL


@query("SELECT doc_id, translate(text, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS eastern, text AS western FROM documents")
def x1_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    eastern = F.translate("text", "0123456789", "۰۱۲۳۴۵۶۷۸۹")
    return d.select("doc_id", eastern.alias("eastern"), numbers.western_digits(eastern).alias("western"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey AS DOUBLE) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END END AS v, CASE WHEN l_linenumber % 3 <> 0 AND l_linenumber % 2 = 1 AND l_partkey > 0 THEN CAST(l_partkey AS DOUBLE) END AS positive FROM lineitem")
def x2_parse_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written with separators, signs, Eastern digits and, every third, a letter."""
    t = table(spark, sf_dir, "lineitem")
    s = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(" "), F.translate(F.format_number("l_partkey", 0), "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.when(F.col("l_linenumber") % 3 == 0, "d").otherwise(" "))
    return t.select("l_orderkey", "l_linenumber", numbers.parse_float(s).alias("v"), numbers.parse_number(s).alias("positive"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS DOUBLE) AS first FROM documents WHERE regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '[0-9][.,][0-9]|[0-9][.,]|[-+][0-9]|^[^0-9]*0')")
def x4_first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]") & ~F.col("text").rlike(r"[0-9][.,][0-9]|[0-9][.,]|[-+][0-9]|\A[^0-9]*0"))
    return d.select("doc_id", numbers.first_number(F.col("text")).alias("first"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 5 AND 8)) AS n FROM documents WHERE NOT regexp_matches(text, '[0-9]{2,3}[\\s,٬،][0-9]{3}')")
def x9_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[0-9]{2,3}[\s,٬،][0-9]{3}"))
    return d.select("doc_id", F.size(numbers.number_tokens(F.col("text"))).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'toman' WHEN l_linenumber = 2 THEN 'rial' WHEN l_partkey * 1000 >= 900000 AND l_partkey * 1000 < 100000000 THEN 'rial' WHEN l_partkey * 1000 BETWEEN 50000 AND 350000 THEN 'toman' ELSE 'unknown' END AS unit FROM lineitem")
def x7_unit_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    s = F.concat(F.when(F.col("l_linenumber") == 1, "in Toman ").when(F.col("l_linenumber") == 2, "Rials ").otherwise(""), (F.col("l_partkey") * 1000).cast("string"))
    return t.select("l_orderkey", "l_linenumber", numbers.unit_of_numbers(s, numbers.number_tokens(s)).alias("unit"))


@query("SELECT o_orderkey, o_orderkey + 10000 AS buy, o_orderkey + 10100 AS sell, o_orderkey + 10000 AS near_buy FROM orders")
def x10_keyword_and_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pair = F.concat(F.lit("rate "), F.col("o_orderkey") + 10000, F.lit(" / "), F.col("o_orderkey") + 10100)
    said = F.concat(F.lit("Sell at 99, buy now: "), F.col("o_orderkey") + 10000)
    a, b = numbers.slash_pair(pair)
    return o.select("o_orderkey", a.alias("buy"), b.alias("sell"), numbers.near_keyword(said, quotes.BUY).alias("near_buy"))


_WORDS = {"a": ("idiot", "clown"), "b": ("the ", "der "), "c": ("euro", "que")}


@query(f"WITH {MESSAGES_SQL} SELECT handle, msg_index, concat_ws('|', CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'clown') THEN 'a' END, CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'der ') THEN 'b' END, CASE WHEN contains(lower(text), 'euro') OR contains(lower(text), 'que') THEN 'c' END) AS hits FROM messages")
def x12_alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.messages(spark, sf_dir).select("handle", "msg_index", F.array_join(text.alias_hits(F.col("text"), _WORDS), "|").alias("hits"))


@query("""WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), 'idiot')) + len(regexp_extract_all(lower(text), 'clown')) AS a, len(regexp_extract_all(lower(text), 'the ')) + len(regexp_extract_all(lower(text), 'der ')) AS b, len(regexp_extract_all(lower(text), 'euro')) + len(regexp_extract_all(lower(text), 'que')) AS c FROM documents)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS best FROM n""")
def x13_best_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.best_alias(F.col("text"), _WORDS).alias("best"))


_EXACT = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_FORM = "substr(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '\\s+', ' ', 'g')), 1, 140)"


@query(f"WITH {MESSAGES_SQL} SELECT handle, msg_index, {_EXACT} AS exact_key, {_FORM} AS form FROM messages")
def x14_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.messages(spark, sf_dir).select("handle", "msg_index", dedup.exact_key(F.col("text")).alias("exact_key"), text.fingerprint(F.col("text")).alias("form"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1, 'is')), '') AS title, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links, count_if(TRUE) AS n FROM pages GROUP BY ALL")
def x17_title_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy("page_id", text.title_of(F.col("html")).alias("title"), F.size(text.links_of(F.col("html"))).alias("links")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', '') AS domain, concat(regexp_extract(url, '^(https?)', 1), '://', regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', ''), regexp_replace(regexp_extract(url, '://[^/]+([^?#]*)', 1), '/+$', '')) AS website FROM pages")
def x18_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"), text.website(F.col("url")).alias("website"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(l, '[ßäöü]| der | und | das ') THEN 'de' WHEN regexp_matches(l, '[ñ]| los | del | una ') THEN 'es' WHEN regexp_matches(l, '[èêç]| les | des | une ') THEN 'fr' WHEN regexp_matches(l, ' the | and | of ') THEN 'en' ELSE 'unknown' END AS language FROM (SELECT doc_id, concat(' ', lower(text), ' ') AS l FROM documents)""")
def x20_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("body"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS t FROM b)
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS body FROM c""")
def x16_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir)


@query("SELECT c_custkey, trim(regexp_replace(lower(concat(c_name, ' (', c_mktsegment, ')')), '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace(lower(concat(c_name, c_mktsegment)), '[^a-z0-9]+', '', 'g') AS symbol, concat('telegram:', lower(c_mktsegment)) AS key FROM customer")
def x29_names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.normal_name(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("name"), text.symbol_token(F.concat("c_name", "c_mktsegment")).alias("symbol"), text.source_key(F.lit("Telegram"), F.concat(F.lit("https://t.me/s/@"), "c_mktsegment", F.lit("/")), F.lit("")).alias("key"))


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT handle, msg_index, {_EXACT} AS ek, substr({_EXACT}, 1, 40) AS nk FROM messages), r AS (SELECT *, row_number() OVER (PARTITION BY handle, nk ORDER BY msg_index) AS i, first_value(ek) OVER (PARTITION BY handle, nk ORDER BY msg_index) AS f FROM k)
    SELECT handle, msg_index, i = 1 AS keep, CASE WHEN i = 1 THEN 'none' WHEN ek = f THEN 'exact_duplicate_in_channel' ELSE 'near_duplicate_in_channel' END AS flag, CASE WHEN i = 1 THEN 60 WHEN ek = f THEN 38 ELSE 44 END AS score FROM r""")
def w5_in_channel_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.in_channel(_keyed(spark, sf_dir), score="score").select("handle", "msg_index", "keep", "flag", "score")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dedup.exact_key(F.col("text"))
    return src.messages(spark, sf_dir).select("handle", "msg_index", e.alias("exact_key"), F.substring(e, 1, 40).alias("near_sig"), F.substring(e, 1, 40).alias("cross_key"), F.lit(60).alias("score"), F.when(F.col("handle") % 3 == 0, "P1").otherwise("P2").alias("priority"))


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT handle, msg_index, {_EXACT} AS ek, substr({_EXACT}, 1, 40) AS nk FROM messages), r AS (SELECT *, row_number() OVER (PARTITION BY handle, nk ORDER BY msg_index) AS i, first_value(ek) OVER (PARTITION BY handle, nk ORDER BY msg_index) AS f FROM k),
    c AS (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY CASE WHEN handle % 3 = 0 THEN 0 ELSE 1 END, handle, msg_index) AS j FROM r WHERE i = 1)
    SELECT handle, msg_index, j = 1 AS keep, CASE WHEN j = 1 THEN 'none' ELSE 'reposted_cross_channel' END AS flag, CASE WHEN j = 1 THEN 60 ELSE 42 END AS score FROM c
    UNION ALL SELECT handle, msg_index, FALSE, CASE WHEN ek = f THEN 'exact_duplicate_in_channel' ELSE 'near_duplicate_in_channel' END, CASE WHEN ek = f THEN 38 ELSE 44 END FROM r WHERE i > 1""")
def w6_cross_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.across_channels(dedup.in_channel(_keyed(spark, sf_dir), score="score")).select("handle", "msg_index", "keep", "flag", "score")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders told as messages of channels, so that every kind of quote occurs."""
    o = table(spark, sf_dir, "orders")
    p = (F.col("o_totalprice") / 10).cast("bigint") + 100_000
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.concat(F.lit("Tehran USD buy "), p, F.lit(" sell "), p + 500)).when(k == 1, F.concat(F.lit("rate euro "), p, F.lit("/"), p + 700, F.lit(" toman"))).when(k == 2, F.concat(F.lit("forwarded from x: dollar usd "), p)).when(k == 3, F.concat(F.lit("address: Herat exchange "), p, F.lit(" "), p + 1)).otherwise(F.concat(F.lit("hello "), "o_orderpriority"))
    return o.select((F.col("o_custkey") % 20).alias("handle"), F.col("o_orderkey").alias("msg_index"), said.alias("text"), F.col("o_orderdate").alias("ts"), F.when(k == 2, "aggregator").otherwise("unclear").alias("channel_type"), (F.col("o_custkey") % 20 < 5).alias("shop"), F.when(F.col("o_custkey") % 2 == 0, "P1").otherwise("P2").alias("priority"))


_QUOTE_SQL = """o AS (SELECT o_custkey % 20 AS handle, o_orderkey AS msg_index, o_orderkey % 5 AS k, CAST(floor(o_totalprice / 10) AS BIGINT) + 100000 AS p, o_custkey % 20 < 5 AS shop FROM orders)"""


@query(f"""WITH {_QUOTE_SQL} SELECT handle, msg_index, CASE k WHEN 0 THEN p WHEN 1 THEN p END AS buy, CASE k WHEN 0 THEN p WHEN 1 THEN p + 700 END AS sell,
    CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'UNKNOWN' END AS currency, CASE WHEN k = 1 THEN 'toman' WHEN CASE k WHEN 0 THEN p + 500 WHEN 3 THEN p + 1 ELSE p END BETWEEN 50000 AND 350000 THEN 'toman' ELSE 'unknown' END AS unit,
    CASE k WHEN 0 THEN 'Tehran' WHEN 3 THEN 'Herat' ELSE 'unknown' END AS city, CASE WHEN k = 2 THEN 'reposted' WHEN shop THEN 'direct' WHEN k = 3 THEN 'direct' ELSE 'unclear' END AS quote_type FROM o WHERE k < 4""")
def x27_quote_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.parse(_quotes(spark, sf_dir), F.lit("2001-08-02").cast("timestamp")).select("handle", "msg_index", "buy", "sell", "currency", "unit", "city", "quote_type")


@query()
def a25_channel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.channel_metrics(quotes.deduplicated(quotes.parse(_quotes(spark, sf_dir), F.lit("2001-08-02").cast("timestamp"))))


@query("""SELECT event_id, CASE WHEN h <= 6 THEN 100 WHEN h <= 24 THEN 88 WHEN h <= 48 THEN 76 WHEN h <= 72 THEN 66 WHEN h <= 168 THEN 45 ELSE 25 END AS points, CASE WHEN h <= 30 THEN 'fresh' WHEN h <= 96 THEN 'recent' WHEN h <= 720 THEN 'stale' ELSE 'old' END AS by_hours, CASE WHEN h / 24 <= 14 THEN 'fresh' WHEN h / 24 <= 60 THEN 'recent' ELSE 'stale' END AS by_days,
    CASE WHEN value >= 85 THEN 'fresh' WHEN value >= 60 THEN 'recent' WHEN value >= 40 THEN 'stale' ELSE 'old' END AS by_points FROM (SELECT event_id, value, date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS h FROM events)""")
def c7_freshness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "ts"))) / 3600.0
    return table(spark, sf_dir, "events").select("event_id", labels.freshness_points(h).alias("points"), labels.freshness_by_hours(h).alias("by_hours"), labels.freshness_by_days(h / 24).alias("by_days"), labels.freshness_by_points(F.col("value")).alias("by_points"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN t <= 0.015 THEN 'low' WHEN t <= 0.03 THEN 'moderate' ELSE 'high' END AS model, CASE WHEN l_linenumber <= 1 THEN 'low' WHEN t <= 0.03 THEN 'low' WHEN t <= 0.08 THEN 'medium' ELSE 'high' END AS board, CASE WHEN t < 0.08 THEN 'low' WHEN t < 0.18 THEN 'medium' ELSE 'high' END AS card, CASE WHEN t <= 0.02 THEN 'low' WHEN t <= 0.05 THEN 'medium' ELSE 'high' END AS research,
    CASE WHEN t * 100 < 2 THEN 'Aligned' WHEN t * 100 <= 10 THEN 'Mild divergence' ELSE 'Divergent' END AS alignment FROM (SELECT *, l_tax * 2.5 AS t FROM lineitem)""")
def c32_dispersion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("l_tax") * 2.5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", labels.dispersion_model(t).alias("model"), labels.dispersion_board(t, F.col("l_linenumber")).alias("board"), labels.dispersion_card(t).alias("card"), labels.dispersion_research(t).alias("research"), labels.alignment(t * 100).alias("alignment"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events")
def d1_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in three ways, and nonsense."""
    ts = F.date_trunc("second", "ts")
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(F.unix_timestamp(ts).cast("string"), F.lit("000"))).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", times.parse_time(s).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -(event_id % 24) * 60 - 30 WHEN event_id % 3 = 1 THEN (event_id % 24) * 60 + 30 END AS minutes FROM events")
def d2_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.when(F.col("event_id") % 3 == 0, "-").when(F.col("event_id") % 3 == 1, "+").otherwise("x"), (F.col("event_id") % 24).cast("string"), F.lit(":30"))
    return table(spark, sf_dir, "events").select("event_id", times.parse_offset(s).cast("long").alias("minutes"))


@query("""WITH e AS (SELECT event_id, CAST(1300 + event_id % 200 AS INTEGER) AS jy, CAST(1 + event_id % 12 AS INTEGER) AS jm, CAST(1 + event_id % 29 AS INTEGER) AS jd, CAST(ts + INTERVAL 210 MINUTE AS DATE) AS here FROM events),
    n AS (SELECT *, (CASE WHEN jm <= 7 THEN 31 * (jm - 1) ELSE 186 + 30 * (jm - 7) END) + jd - 1 AS into_year FROM e),
    y AS (SELECT u AS y, DATE '1600-03-20' + CAST(365 * (u - 979) + 8 * ((u - 979) // 33) + ((u - 979) % 33 + 3) // 4 AS INTEGER) AS first FROM generate_series(1300, 1500) t(u)),
    c AS (SELECT n.event_id, arg_min(first + into_year, abs(first + into_year - here) * 10000 + y) AS nearest FROM n JOIN y ON y BETWEEN year(here) - 625 AND year(here) - 618 GROUP BY 1)
    SELECT event_id, jy, jm, jd, first + into_year AS date, nearest FROM n JOIN y ON y = jy JOIN c USING (event_id)""")
def d4_jalali(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    y, m, d = (1300 + F.col("event_id") % 200).cast("int"), (1 + F.col("event_id") % 12).cast("int"), (1 + F.col("event_id") % 29).cast("int")
    return e.select("event_id", y.alias("jy"), m.alias("jm"), d.alias("jd"), times.jalali_to_date(y, m, d).alias("date"), times.nearest_jalali(d, m, F.col("ts").cast("timestamp")).alias("nearest"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000 / 705 END, 6) AS implied, CASE WHEN c_acctbal BETWEEN 1000 AND 5000 THEN c_acctbal END AS bounded, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 10 ELSE c_acctbal END, 4) AS rial FROM customer")
def m1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    unit = F.when(F.col("c_mktsegment") == "BUILDING", " Toman ").otherwise("rial")
    return c.select("c_custkey", F.round(numbers.implied_fx(F.col("c_acctbal") * 1000, F.lit(3000.0)), 6).alias("implied"), numbers.bounded(F.col("c_acctbal"), 1000, 5000).alias("bounded"), F.round(numbers.to_rial(F.col("c_acctbal"), unit), 4).alias("rial"))


@query("SELECT part.p_partkey, left(sha256(concat(p_name, '|', p_brand)), 12) AS fingerprint FROM part")
def n8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.left(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), F.lit(12)).alias("fingerprint"))


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def n1_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))


@query(f"WITH {MESSAGES_SQL}, f AS (SELECT handle, {_FORM} AS form, count(*) AS n FROM messages GROUP BY 1, 2) SELECT handle, round(max(n) / sum(n), 8) AS stability FROM f GROUP BY 1")
def a40_form_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = src.messages(spark, sf_dir).groupBy("handle", text.fingerprint(F.col("text")).alias("form")).count()
    return f.groupBy("handle").agg(F.round(F.max("count") / F.sum("count"), 8).alias("stability"))


@query("SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END) AS BIGINT) AS with_word FROM conversations GROUP BY 1")
def a41_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.contains_any(F.col("text"), ("the ",))).alias("with_word"))


@query("WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)', 1)) AS block FROM pages) SELECT page_id, count(*) AS blocks, max(length(block)) AS longest FROM s GROUP BY 1")
def s18_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("i", "block"))
    return b.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.max(F.length("block")).cast("long").alias("longest"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY value DESC, event_id) AS k FROM events) SELECT event_id, user_id, value FROM r WHERE k = 1")
def w9_minute_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return dedup.first_by(e, ["user_id", "minute"], [F.col("value").desc(), F.col("event_id")]).select("event_id", "user_id", "value")


@query("SELECT DISTINCT event_type, user_id % 10 AS u FROM events")
def u10_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("u")).dropDuplicates()
