"""Messages to quote records, their scores, and metrics per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions import labels, numbers, text
from ratemill.operators import dedup

BUY = tuple("خرید buy bid".split())
SELL = tuple("فروش sell offer ask".split())
QUOTE = tuple("نرخ قیمت rate quote fx ارز".split())
SHOP = tuple("address exchange whatsapp آدرس تلگرام تماس صرافی".split())
REPOST = tuple("via @|source:|forwarded from|بازنشر|فوروارد|منبع".split("|"))
NETWORK = tuple("dealer|market|quote channel|بازار|شبکه|کانال|همکار".split("|"))
AGGREGATED = tuple("aggregator dealer_network_channel market_price_channel".split())


def quote_type(t: Column, channel_type: Column, shop: Column) -> Column:
    return (
        F.when(text.contains_any(t, REPOST), "reposted").when(channel_type.isin(*AGGREGATED), "aggregated").when(shop, "direct")
        .when(text.contains_any(t, SHOP), "direct").when(text.contains_any(t, NETWORK), "aggregated").otherwise("unclear")
    )


def structure_points(has_word: Column, currencies: Column, n_numbers: Column, buy: Column, sell: Column, cities: Column, unit: Column) -> Column:
    one = lambda c, n: F.when(c, n).otherwise(0)
    pair = F.when(buy.isNotNull() & sell.isNotNull(), 30).when(buy.isNotNull() | sell.isNotNull(), 14).otherwise(0)
    total = one(F.size(currencies) > 0, 20) + one(n_numbers > 0, 10) + pair + one(n_numbers >= 2, 12) + one(n_numbers >= 4, 6) + one(F.size(cities) > 0, 8) + one(unit != "unknown", 8) + one(has_word, 10)
    return F.least(F.lit(100), total)


def directness_points(kind: Column, shop: Column) -> Column:
    return F.when((kind == "direct") & shop, 90).when(kind == "direct", 82).when(kind == "aggregated", 58).when(kind == "reposted", 34).otherwise(48)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with further columns that are computed once per row: a generator of one row, which neither filters nor projections are merged with."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: reading patterns out of text is bound by CPU, and a small file is one partition. Large tables have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def parse(messages: DataFrame, now: Column) -> DataFrame:
    """Quote records of messages (handle, msg_index, text, ts, channel_type, shop, priority); messages without a quote are dropped."""
    t, low = F.col("_t"), F.col("_low")
    base = once(spread(messages), _t=numbers.western_digits(F.col("text")), _low=F.lower(numbers.western_digits(F.col("text"))))
    # no number, no quote: what looks for one near a word is spared then
    some_number = F.when(t.rlike(r"[0-9]{5}|[0-9]{2}[،٬,\s][0-9]{3}"), low)
    a, b = numbers.slash_pair(some_number, True)
    base = once(base, numbers=F.coalesce(numbers.number_tokens(some_number, True), F.array().cast("array<bigint>")), _buy=numbers.near_keyword(some_number, BUY, True), _sell=numbers.near_keyword(some_number, SELL, True), _a=a, _b=b)
    neither = F.col("_buy").isNull() & F.col("_sell").isNull()
    two = neither & (F.size("numbers") >= 2) & text.contains_any(low, BUY + SELL, True)
    slashed = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    buy = F.coalesce("_buy", F.when(neither & slashed, F.col("_a")), F.when(F.col("_sell").isNotNull(), F.col("_a")), F.when(two, F.get("numbers", F.lit(0))))
    sell = F.coalesce("_sell", F.when(neither & slashed, F.col("_b")), F.when(F.col("_buy").isNotNull(), F.col("_b")), F.when(two, F.get("numbers", F.lit(1))))
    full = once(
        base.where((F.size("numbers") > 0) | F.coalesce("_buy", "_sell", "_a", "_b").isNotNull()), buy=buy, sell=sell, currencies=text.alias_hits(low, text.CURRENCIES, True), cities=text.alias_hits(low, text.CITIES, True), unit=numbers.unit_of_numbers(t, F.col("numbers")),
        has_word=text.contains_any(low, QUOTE, True), quote_type=quote_type(t, F.col("channel_type"), F.col("shop")),
    )
    both = F.col("buy").isNotNull() & F.col("sell").isNotNull()
    some = F.col("buy").isNotNull() | F.col("sell").isNotNull()
    like = ((F.size("numbers") > 0) & ((F.size("currencies") > 0) | F.col("has_word") | (F.size("cities") > 0) | some)) | both
    kept = full.where(like)
    hours = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600
    near = dedup.near_key(t)
    key = dedup.number_key(F.concat("numbers", F.array_compact(F.array("buy", "sell"))))
    money = F.coalesce(F.nullif(F.array_join("currencies", "|"), F.lit("")), F.lit("UNKNOWN"))
    scored = once(
        kept, freshness=labels.freshness_points(F.greatest(hours, F.lit(0.0))), structure=structure_points(F.col("has_word"), F.col("currencies"), F.size("numbers"), F.col("buy"), F.col("sell"), F.col("cities"), F.col("unit")),
        directness=directness_points(F.col("quote_type"), F.col("shop")), currency=money, near_sig=F.concat_ws("|", near, key, money),
    )
    return scored.select(
        "handle", "msg_index", "priority", "shop", "channel_type", "quote_type", "freshness", "structure", "directness", "buy", "sell", "unit", "numbers", "currency",
        F.coalesce(F.get("cities", F.lit(0)), F.lit("unknown")).alias("city"), ((F.col("buy") + F.col("sell")) / 2).alias("midpoint"),
        numbers.to_rial((F.col("buy") + F.col("sell")) / 2, F.col("unit")).alias("midpoint_rial"), F.bround(0.40 * F.col("structure") + 0.35 * F.col("freshness") + 0.25 * F.col("directness")).cast("int").alias("score"),
        dedup.exact_key(t).alias("exact_key"), "near_sig", F.col("near_sig").alias("cross_key"),
    )


def deduplicated(records: DataFrame) -> DataFrame:
    """First within channels, then across them on the reduced scores."""
    return dedup.across_channels(dedup.in_channel(records, score="score"))


def channel_metrics(records: DataFrame) -> DataFrame:
    """Counts, mean quality, readiness and status of each channel of deduplicated records."""
    kept = F.col("keep")
    agg = records.groupBy("handle").agg(
        F.count(F.lit(1)).alias("extracted"), F.count_if(kept).alias("kept"), F.count_if(F.array_contains(F.split("currency", r"\|"), "USD")).alias("usd"), F.count_if(F.col("buy").isNotNull() & F.col("sell").isNotNull()).alias("pairs"),
        F.count_if(F.col("quote_type") == "direct").alias("direct"), F.count_if(~kept | (F.col("quote_type") == "reposted")).alias("reposted"), F.coalesce(F.avg(F.when(kept, F.col("score"))), F.avg("score")).alias("quality"),
    )
    ratio = lambda c: F.when(F.col("kept") > 0, F.col(c) / F.greatest(F.col("kept"), F.lit(1))).otherwise(0.0)
    raw = 0.45 * F.col("quality") + 0.25 * F.least(F.lit(100.0), F.col("kept") * 10.0) + 15 * ratio("pairs") + 15 * ratio("direct")
    raw = raw - F.when(1 - F.col("kept") / F.col("extracted") > 0.5, 10).otherwise(0) - F.when(F.col("kept") < 3, 10).otherwise(0)
    ready = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    status = labels.channel_status(F.col("extracted"), F.col("kept"), F.col("direct"), F.col("quality"), F.col("readiness"), F.col("pairs"))
    return agg.withColumn("readiness", ready).withColumn("status", status)
