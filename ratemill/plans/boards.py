"""Queries of boards of many places, of what pages show, and of values in payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.functions import pages, payloads
from ratemill.operators import boards
from ratemill.operators.quotes import once, spread
from ratemill.plans.registry import query, table

_P = "o AS (SELECT *, o_orderkey % 5 AS k, CAST(floor(o_totalprice / 20) AS BIGINT) + 140000 AS p FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    return spread(table(spark, sf_dir, "orders")), F.col("o_orderkey") % 5, F.floor(F.col("o_totalprice") / 20).cast("bigint") + 140_000


@query(f"""WITH {_P}, q AS (
    SELECT o_orderkey, 'Tehran' AS place, p AS buy, p + 200 AS sell, (2 * p + 200) * 5.0 AS rate, 'toman' AS unit, 'midpoint' AS basis, 'USD' AS currency FROM o WHERE k = 0
    UNION ALL SELECT o_orderkey, 'Herat', p + 300, p + 400, (2 * p + 700) * 5.0, 'toman', 'midpoint', 'USD' FROM o WHERE k = 0
    UNION ALL SELECT o_orderkey, 'Dubai', NULL, NULL, (p // 4 + 3000) * 10 * 3.6725, 'toman', 'single_value', 'AED' FROM o WHERE k = 0
    UNION ALL SELECT o_orderkey, 'London', p + 30000, p + 40000, (2 * p + 70000) * 5.0 / 1.3, 'toman', 'midpoint', 'GBP' FROM o WHERE k = 1
    UNION ALL SELECT o_orderkey, 'Germany', NULL, p + 20000, (p + 20000) * 10 / 1.14, 'toman', 'sell', 'EUR' FROM o WHERE k = 2
    UNION ALL SELECT o_orderkey, 'Qatar', NULL, NULL, (p // 4 + 5000) * 10 * 3.64, 'toman', 'single_value', 'QAR' FROM o WHERE k = 3
    UNION ALL SELECT o_orderkey, 'Turkey', NULL, NULL, (p // 4 + 1000) * 45.18, 'rial', 'single_value', 'TRY' FROM o WHERE k = 3)
    SELECT o_orderkey, place, buy, sell, round(rate, 4) AS rate, unit, basis, currency FROM q WHERE rate BETWEEN 1450000 * 0.45 AND 1450000 * 1.8""")
def x23_board_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards with a line per place, boards in one line, and single notes, one kind for each of four orders."""
    o, k, p = _orders(spark, sf_dir)
    quarter = F.floor(p / 4).cast("bigint")
    said = (
        F.when(k == 0, F.concat(F.lit("تهران "), p, F.lit(" / "), p + 200, F.lit("\nهرات "), p + 300, F.lit(" / "), p + 400, F.lit("\nدبی درهم "), quarter + 3000))
        .when(k == 1, F.concat(F.lit("نرخ پوند امروز لندن خرید: "), p + 30_000, F.lit(" فروش: "), p + 40_000, F.lit(" تومان")))
        .when(k == 2, F.concat(F.lit("حواله 68788 آلمان فروش یورو "), F.translate((p + 20_000).cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit(" تومان")))
        .when(k == 3, F.concat(F.lit("لیر ترکیه : "), quarter + 1000, F.lit(" ریال ریال قطر : "), quarter + 5000, F.lit(" تومان درهم x")))
        .otherwise(F.lit("closed today"))
    )
    return boards.board_quotes(o.select("o_orderkey", said.alias("text")), "o_orderkey", "text", 1_450_000.0).withColumn("rate", F.round("rate", 4))


@query(f"""WITH {_P} SELECT o_orderkey, 'AED' AS currency, p // 4 + 5000 AS value, CASE WHEN k = 1 THEN 'rial' ELSE 'toman' END AS unit, CAST((p // 4 + 5000) * CASE WHEN k = 1 THEN 1 ELSE 10 END AS DOUBLE) AS rial FROM o WHERE k < 2 AND (p // 4 + 5000) * CASE WHEN k = 1 THEN 1 ELSE 10 END * 3.6725 BETWEEN 1450000 * 0.55 AND 1450000 * 1.65
    UNION ALL SELECT o_orderkey, 'USD', p, 'toman', p * 10.0 FROM o WHERE k = 2 AND p * 10 BETWEEN 1450000 * 0.55 AND 1450000 * 1.65""")
def x26_direct_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, p = _orders(spark, sf_dir)
    quarter = F.floor(p / 4).cast("bigint") + 5000
    block = F.when(k == 0, F.concat(F.lit("نرخ تبدیل درهم به تومان در حال حاضر "), quarter, F.lit(" تومان است"))).when(k == 1, F.concat(F.lit("AED today: "), quarter, F.lit(" rial"))).when(k == 2, F.concat(F.lit("usd "), p)).otherwise("no rate")
    r = once(o.select("o_orderkey", block.alias("b")), r=pages.direct_rates(F.col("b"), 1_450_000.0))
    return r.select("o_orderkey", F.inline("r"))


_AT = "n AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderkey % 24 AS INTEGER) AS h, CAST(o_orderkey % 60 AS INTEGER) AS m, CAST(1 + o_orderkey % 28 AS INTEGER) AS d FROM orders)"


@query(f"""WITH {_AT} SELECT o_orderkey, CASE k WHEN 0 THEN DATE '2026-03-20' + d + INTERVAL (h * 60 + m) MINUTE WHEN 1 THEN DATE '2026-04-20' + d + INTERVAL 0 MINUTE WHEN 2 THEN make_timestamp(2026, 3, d, (h % 12) + 12, m, 0) END AS shown FROM n""")
def d8_update_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Jalali date with a time, one without, a Gregorian one in Persian after noon, none."""
    k, h, m, d = F.col("o_orderkey") % 4, F.col("o_orderkey") % 24, F.col("o_orderkey") % 60, 1 + F.col("o_orderkey") % 28
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    said = (
        F.when(k == 0, F.concat(F.lit("به روز رسانی: سه شنبه "), two(d), F.lit(" فروردین 1405 ساعت "), two(h), F.lit(":"), two(m))).when(k == 1, F.concat(F.lit("اردیبهشت "), F.translate(d.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit(", ۱۴۰۵")))
        .when(k == 2, F.concat(F.lit("مارس "), d, F.lit(", 2026 - "), F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12), F.lit(":"), two(m), F.lit(" ب.ظ"))).otherwise("soon")
    )
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", pages.update_time(said).cast("timestamp_ntz").alias("shown"))


@query(f"""WITH {_AT} SELECT o_orderkey, DATE '2026-03-20' + d + INTERVAL 510 MINUTE AS history, CASE WHEN h * 60 + m > 15 * 60 + 10 + 210 + 10 - 0 THEN TIMESTAMP '2026-05-02 00:00:00' ELSE TIMESTAMP '2026-05-03 00:00:00' END + INTERVAL (h * 60 + m - 210) MINUTE AS current, h * 60 + m AS minutes FROM n""")
def d6_page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of a history, the time of the current rate sampled at 15:10 UTC, a time of the day."""
    h, m, d = F.col("o_orderkey") % 24, F.col("o_orderkey") % 60, 1 + F.col("o_orderkey") % 28
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(h), F.lit(":"), two(m))
    history = F.concat(F.lit("<tr><td>1404/12/29</td><td>1</td></tr><td> 1405 / 1 / "), d, F.lit(" </td><td>1405/13/40</td>"))
    current = F.concat(F.lit("<div>یکشنبه ۱۳ اردیبهشت - x</div><td class='a'>زمان ثبت آخرین نرخ</td> <td>"), F.translate(clock, "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit(":00</td>"))
    return spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", pages.history_time(history).cast("timestamp_ntz").alias("history"), pages.profile_time(current, F.lit("2026-05-03 15:10:00").cast("timestamp")).cast("timestamp_ntz").alias("current"), pages.hhmm(clock).alias("minutes")
    )


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads: two symbols with times of their own, a path that speaks for itself, and linked data in a page."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    day = lambda c: F.concat(F.lit("2026-04-"), F.lpad(c.cast("string"), 2, "0"), F.lit(" 00:00:00"))
    body = F.concat(
        F.lit('{"current": {"first_usd": {"p": "'), v, F.lit('", "ts": "'), day(1 + k % 20), F.lit('"}, "list": [{"code": "second_usd", "sell": "'), (k + 1000).cast("string"), F.lit('", "updated": "'), day(1 + k % 7), F.lit('"}]}, "market": {"usd_irr": {"price": "'), (k + 200_000).cast("string"),
        F.lit('"}}, "official": {"usd": '), (k + 20_000).cast("string"), F.lit("}}"),
    )
    page = F.concat(F.lit("<script type='application/ld+json'>{bad</script><script type=\"application/ld+json\">{\"@graph\": [{\"@type\": \"Product\", \"offers\": {\"price\": \""), v, F.lit("\"}}]}</script>"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", body.alias("body"), page.alias("page"))


@query("SELECT o_orderkey AS key, CAST('2026-04-01' AS TIMESTAMP) + INTERVAL (greatest(o_orderkey % 20, o_orderkey % 7)) DAY AS quote_time FROM orders")
def n3_symbol_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.symbol_time(_payloads(spark, sf_dir), "o_orderkey", "body", ("FIRST-usd", "second_usd"), 4).withColumn("quote_time", F.col("quote_time").cast("timestamp_ntz"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 20 > o_orderkey % 7 THEN o_totalprice ELSE CAST(o_orderkey + 1000 AS DOUBLE) END AS value, CASE WHEN o_orderkey % 20 > o_orderkey % 7 THEN 'first_usd' ELSE 'second_usd' END AS symbol FROM orders")
def o7_symbol_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.by_priority(_payloads(spark, sf_dir), "o_orderkey", "body", ("second_usd", "first_usd", "third"), 4)


@query("SELECT o_orderkey AS key, CAST(o_orderkey + 200000 AS DOUBLE) AS value FROM orders")
def n5_path_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.path_value(_payloads(spark, sf_dir), "o_orderkey", "body", "open_market", 4)


@query("""SELECT o_orderkey AS key, 'official' AS benchmark, o_totalprice AS value, 'first_usd' AS symbol FROM orders UNION ALL SELECT o_orderkey, 'open_market', CAST(o_orderkey + 1000 AS DOUBLE), NULL FROM orders UNION ALL SELECT o_orderkey, 'path', CAST(o_orderkey + 20000 AS DOUBLE), NULL FROM orders""")
def n6_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the source's own symbol; by any symbol of the benchmark; by the path; and nothing where only its own may do."""
    ways = {
        "official": ("official", ("none", "first_usd"), ("second_usd",), True), "open_market": ("open_market", ("none",), ("second_usd",), False), "path": ("official", (), (), False), "strict": ("official", ("none",), ("first_usd",), True),
    }
    return payloads.resolved_ways(_payloads(spark, sf_dir), "o_orderkey", "body", ways, 4).withColumnRenamed("way", "benchmark")


@query("SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
def n7_product_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.product_price(_payloads(spark, sf_dir), "o_orderkey", "page", 4)
