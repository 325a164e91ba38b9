"""Queries of what is read out of pages and of the messages on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import numbers, probes, text
from ratemill.operators.quotes import once, spread
from ratemill.plans.registry import query, table
from ratemill.plans.rules import _SQL, cases

_c = F.col


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN p WHEN o_orderkey % 3 = 1 THEN p + 7 END AS value FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 10) AS BIGINT) + 100000 AS DOUBLE) AS p FROM orders)")
def y9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number in range among what selectors found; numbers out of range are passed over."""
    k, p = _c("o_orderkey"), F.floor(_c("o_totalprice") / 10).cast("bigint") + 100_000
    entry = lambda **f: F.struct(*[F.coalesce(f.get(n, F.lit(None).cast("string")), F.lit("")).alias(n) for n in probes.SHOWN])
    rows = F.when(k % 3 == 0, F.array(entry(dataValue=F.lit("12"), text=p.cast("string")), entry(value=F.lit("150000")))).when(k % 3 == 1, F.array(entry(text=F.lit("sell")), entry(content=(p + 7).cast("string")))).otherwise(F.array(entry(text=F.lit("99"))))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", probes.selected(rows, 100_000, 3_000_000).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN p WHEN o_orderkey % 4 = 1 THEN p + 1 WHEN o_orderkey % 4 = 2 THEN p + 2 END AS value FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 10) AS BIGINT) + 100000 AS DOUBLE) AS p FROM orders)")
def y10_near_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = _c("o_orderkey"), F.floor(_c("o_totalprice") / 10).cast("bigint") + 100_000
    page = F.when(k % 4 == 0, F.concat(F.lit("US Dollar sell: "), p, F.lit(", gold 5"))).when(k % 4 == 1, F.concat(p + 1, F.lit(" دلار"))).when(k % 4 == 2, F.concat(F.lit("us dollar 99,999,999 and دلار ــ "), F.translate((p + 2).cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit("."))).otherwise("us dollar 12")
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", probes.near_hint(page, ("us dollar", "دلار"), 100_000, 3_000_000).alias("value"))


@query(f"WITH {_SQL} SELECT k, CASE WHEN is_phone THEN 'toman' WHEN k % 4 = 0 THEN CASE WHEN k * 1000 >= 700000 THEN 'rial' WHEN k * 1000 BETWEEN 50000 AND 350000 THEN 'toman' ELSE 'unknown' END WHEN k % 4 = 1 THEN 'toman' ELSE 'unknown' END AS unit FROM cases")
def y25_region_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("k")
    values = F.when(k % 4 == 1, F.array(F.lit(60_000), F.lit(340_000), F.lit(900_000))).otherwise(F.array().cast("array<int>"))
    return cases(spark, sf_dir).select("k", probes.region_unit(F.when(_c("is_phone"), "5 TMN").otherwise("x"), values, F.when(k % 4 == 0, (k * 1000).cast("double"))).alias("unit"))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['Herat', 'Tehran'] ELSE ['Dubai'] END) AS region, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'AED' END AS currency, p AS midpoint, p * 10 AS rial FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice / 10) AS BIGINT) + 100000 AS DOUBLE) AS p FROM orders) WHERE o_orderkey % 3 < 2")
def y24_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each region that a message names; of several currencies the dollar. The number nearest before a word counts as well as one after it."""
    k, p = _c("o_orderkey"), F.floor(_c("o_totalprice") / 10).cast("bigint") + 100_000
    said = F.when(k % 3 == 0, F.concat(F.lit("Tehran and Herat: euro, usd buy "), p, F.lit(" sell "), p + 100, F.lit(" toman"))).when(k % 3 == 1, F.concat(F.lit("dubai aed buy "), p, F.lit(" sell "), p + 100, F.lit(" toman"))).otherwise("nowhere")
    m = once(spread(table(spark, sf_dir, "orders")).select("o_orderkey", said.alias("said")), low=F.lower("said"))
    r = once(m, regions=text.alias_hits(_c("low"), text.CITIES, True), money=text.alias_hits(_c("low"), text.CURRENCIES, True), buy=numbers.near_keyword(_c("low"), ("buy",), True), sell=numbers.near_keyword(_c("low"), ("sell",), True))
    mid = (_c("buy") + _c("sell")) / 2
    unit = probes.region_unit(_c("said"), F.array().cast("array<bigint>"), mid)
    money = F.when(F.array_contains("money", "USD"), "USD").otherwise(F.coalesce(F.get("money", F.lit(0)), F.lit("USD")))
    return r.select("o_orderkey", F.explode("regions").alias("region"), money.alias("currency"), mid.alias("midpoint"), numbers.to_rial(mid, unit).alias("rial"))


@query(f"WITH {_SQL}, x AS (SELECT *, CASE WHEN is_named THEN 1000000 + v * 50 WHEN is_phone THEN 200000 + v * 50 END AS r FROM cases) SELECT k, round(CASE WHEN is_mapped AND r BETWEEN 797500 AND 2392500 THEN r WHEN r BETWEEN 100000 AND 900000 THEN r END, 4) AS value, CASE WHEN is_mapped AND r BETWEEN 797500 AND 2392500 THEN 'USD' WHEN r BETWEEN 100000 AND 900000 THEN 'AED' ELSE 'AED' END AS currency FROM x")
def y57_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    none = F.lit(None).cast("double")
    n = probes.normalized(F.when(_c("is_mapped"), "UNKNOWN|AED|USD").otherwise("AED"), none, F.when(_c("is_named"), 1_000_000 + _c("v") * 50), F.when(~_c("is_named") & _c("is_phone"), 200_000 + _c("v") * 50), 1_450_000.0)
    return c.select("k", n.alias("n")).select("k", F.round("n.value", 4).alias("value"), "n.currency")


@query(f"WITH {_SQL} SELECT k, CASE WHEN is_named THEN ['https://x.org/', 'https://x.org/rates/usd'] ELSE ['https://x.org/', 'https://x.org/a/price'] END AS pages FROM cases")
def y54_rate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "https://www.x.org/a/b"
    html = F.when(_c("is_named"), '<a href="/rates/usd?x=1"> <a href="https://other.org/rates"> <a href="/about">').otherwise('<a href="price"><a href="//www.x.org/a/price">')
    return cases(spark, sf_dir).select("k", probes.rate_pages(F.lit(base), html).alias("pages"))


@query(f"WITH {_SQL} SELECT k, CASE WHEN is_named THEN [concat('one usd ', k, ' two three AED ', k), concat('usd ', k, ' two three AED ', k, ' four')] ELSE [] END AS blocks FROM cases")
def y55_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(_c("is_named"), F.concat(F.lit("<p>one</p><script>usd 5</script><div>usd "), _c("k"), F.lit("</div>two<br>three<p>AED "), _c("k"), F.lit("</p>four"))).otherwise("<p>nothing to see</p>")
    return cases(spark, sf_dir).select("k", probes.rate_blocks(page, 2, 3).alias("blocks"))


@query(f"WITH {_SQL} SELECT k, least(30, quotes + 20) AS quotes, CASE WHEN is_phone THEN quotes ELSE 0 END AS pairs FROM cases")
def y63_quote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the first thirty blocks, whose order matters only beyond them."""
    n = _c("quotes").cast("int")
    pair = F.when(_c("is_phone"), "buy 150000 sell 151000").otherwise("rate 150000")
    blocks = F.concat(F.array_repeat(pair, n), F.array_repeat(F.lit("price USD 140000"), 20), F.array_repeat(F.lit("buy nothing"), 50))
    return once(spread(cases(spark, sf_dir)).select("k", blocks.alias("blocks")), c=probes.quote_counts(F.col("blocks"))).select("k", "c.quotes", "c.pairs")


@query(f"WITH {_SQL} SELECT k, CASE WHEN is_named THEN 'Good Shop' WHEN is_phone THEN 'Desc here' WHEN is_address THEN 'My Shop' WHEN is_hint THEN 'a b c' ELSE 'nowhere' END AS name FROM cases")
def y61_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(_c("is_address"), "https://www.my-shop.com/x").otherwise("nowhere")
    links = F.when(_c("is_hint"), F.array(F.lit("https://t.me/x"), F.lit("https://instagram.com/a_b.c"))).otherwise(F.array().cast("array<string>"))
    return cases(spark, sf_dir).select("k", probes.name_of(F.when(_c("is_named"), "Good Shop | Home").otherwise("abc"), F.when(_c("is_phone"), "Desc here").otherwise(""), url, links).alias("name"))


@query(f"WITH {_SQL} SELECT k, parse + quotes * 4 + CASE WHEN is_shop THEN 14 ELSE 0 END + CASE WHEN kind IN ('dealer_network_channel', 'market_price_channel') THEN 8 ELSE 0 END AS points FROM cases WHERE NOT is_hint AND (quotes > 0 OR parse >= 50 OR is_shop OR (kind IN ('dealer_network_channel', 'market_price_channel') AND parse >= 35))")
def f18_survey_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = probes.survey_keeps(_c("quotes"), _c("parse"), _c("is_shop"), _c("kind"), F.when(_c("is_hint"), "error_404").otherwise("ok"))
    return cases(spark, sf_dir).select("k", p.alias("points")).where("points IS NOT NULL")


@query(f"WITH {_SQL} SELECT k, round(CASE WHEN is_named THEN 5.0 WHEN is_phone AND is_address THEN (100 + 200) / 2.0 WHEN v > 0 THEN v END, 4) AS estimate FROM cases")
def n9_point_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    e = probes.point_estimate((none, F.when(_c("is_named"), 5.0)), (F.lit(-1.0), F.when(_c("is_phone"), 100.0)), (F.when(_c("is_address"), 200.0),), (none, _c("v")))
    return cases(spark, sf_dir).select("k", F.round(e, 4).alias("estimate"))


@query(f"WITH {_SQL} SELECT k, CASE WHEN v > 0 THEN v WHEN parse > 0 THEN CAST(parse AS DOUBLE) WHEN score > 0 THEN CAST(score AS DOUBLE) END AS rate FROM cases")
def y17_first_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("k", probes.first_positive(_c("v"), _c("parse"), _c("score")).alias("rate"))
