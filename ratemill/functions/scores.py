"""Points and classes of discovered sources. Each belongs to another survey; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHOPS = tuple("exchange_shop remittance_exchange settlement_exchange".split())
MARKETS = tuple("exchange_shop regional_market_channel settlement_exchange".split())


def one(c: Column, n: float) -> Column:
    return F.when(c, n).otherwise(0)


def most(c: Column, n: float) -> Column:
    return F.least(c, F.lit(n))


def percent(c: Column) -> Column:
    """0 to 100, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c).cast("int")))


def freshness_points(days: Column, empty: Column, no_text: Column) -> Column:
    """0 to 12 by age in days; 1 for a source never seen (0 without text), 2 for a time that can't be read."""
    return F.when(empty, F.when(no_text, 0).otherwise(1)).when(days.isNull(), 2).when(days <= 3, 12).when(days <= 14, 10).when(days <= 45, 7).when(days <= 180, 4).when(days <= 365, 2).otherwise(0)


def contribution_points(locality: Column, known: Column) -> Column:
    """More for localities that have few sources yet."""
    return F.when(locality == "unknown", 1).when(known <= 1, 10).when(known <= 3, 9).when(known <= 6, 7).when(known <= 10, 5).otherwise(3)


def stability_points(status: Column, quotes: Column, pairs: Column, fresh: Column, parse: Column, ref_quotes: Column, ref_pairs: Column) -> Column:
    q, p = F.greatest(ref_quotes, F.lit(1.0)), F.greatest(ref_pairs, F.lit(1.0))
    points = F.when(quotes >= q * 0.75, 4).when(quotes >= q * 0.40, 2).otherwise(0) + F.when(pairs >= p * 0.50, 4).when(pairs > 0, 2).otherwise(0) + one(fresh >= 7, 2) + one(parse >= 70, 2)
    return F.when(status == "ok", F.least(points, F.lit(12))).when(status == "ok_no_text", 1).otherwise(0)


def operational_score(parse: Column, quotes: Column, pairs: Column, shop: Column, kind: Column, suspicious: Column, parts: list[Column], ref_quotes: Column, ref_pairs: Column) -> Column:
    """parts: freshness, usefulness of the locality, contribution, stability."""
    q, p = F.greatest(ref_quotes, F.lit(1.0)), F.greatest(ref_pairs, F.lit(1.0))
    total = most(parse, 100) * 0.35 + most(quotes / q * 15.0, 15.0) + most(pairs / p * 20.0, 20.0) + one(shop, 12.0)
    for x in parts:
        total = total + x
    total = total + F.when(kind == "exchange_shop", 6.0).when(kind == "regional_market_channel", 8.0).when(kind == "settlement_exchange", 4.0).when(kind == "aggregator", -8.0).otherwise(-10.0) - one(suspicious, 12.0)
    return percent(total)


def operational_bucket(kind: Column, quotes: Column, pairs: Column, shop: Column, score: Column, fresh: Column) -> Column:
    return (
        F.when(kind.isin("unknown", "aggregator") & (quotes == 0) & ~shop, "reject")
        .when((score >= 75) & (fresh >= 4) & kind.isin("exchange_shop", "regional_market_channel") & ((pairs >= 4) | (quotes >= 8)), "P1")
        .when((score >= 60) & (fresh >= 2) & kind.isin(*MARKETS) & ((quotes > 0) | shop | (fresh >= 7)), "P2")
        .when((score >= 30) & (kind != "unknown"), "monitor_only")
        .when((score >= 40) & shop, "monitor_only")
        .otherwise("reject")
    )


def parseable(quotes: Column, texts: Column, posts: Column, numeric: Column) -> Column:
    t = F.greatest(texts, F.lit(1))
    share = most(texts / F.greatest(posts, F.lit(1)), 1.0)
    raw = 100 * (0.40 * most(quotes / t, 1.0) + 0.25 * most(numeric / t, 1.0) + 0.20 * share + 0.15 * most(posts / 30.0, 1.0))
    return F.when(posts <= 0, 0).otherwise(percent(raw * F.when(share < 0.30, 0.75).otherwise(1.0) * F.when(quotes == 0, 0.5).otherwise(1.0)))


def reliability(parse: Column, fresh: Column, repeated: Column, n: Column, usd: Column, aed: Column, remit: Column, kind: Column) -> Column:
    return percent(0.45 * parse + most(n * 6, 18) + one(repeated, 12) + one(usd, 10) + one(aed, 6) + one(remit, 8) + F.when(fresh == "fresh", 16).when(fresh == "recent", 10).when(fresh == "stale", -8).otherwise(0) + one(kind.isin(*SHOPS), 8))


def use_status(n: Column, repeated: Column, fresh: Column, points: Column, signal: Column) -> Column:
    return F.when(~signal | (n == 0), "no_usable_signal").when(fresh == "stale", "stale").when((n >= 3) & repeated & (points >= 68), "publishable").when((n >= 1) & (points >= 42), "monitor_only").otherwise("no_usable_signal")


def support(publishable: Column, monitored: Column, records: Column) -> Column:
    return F.when((publishable >= 2) & (records >= 6), "full_card").when((publishable >= 1) | ((monitored >= 2) & (records >= 3)), "monitor_card").otherwise("still_hidden")


def parse_multilingual(quotes: Column, pairs: Column, phone: Column, address: Column, platform: Column, kind: Column) -> Column:
    return percent(most(quotes * 8, 40) + most(pairs * 10, 30) + one(phone, 8) + one(address, 8) + one(platform == "telegram", 6) + one(kind.isin(*MARKETS), 8))


def parse_uae(quotes: Column, usd: Column, aed: Column, telegram: Column, instagram: Column, whatsapp: Column, page: Column) -> Column:
    return percent(most(quotes * 8, 40) + one(usd, 18) + one(aed, 12) + one(page, 12) + one(telegram, 8) + one(instagram, 6) + one(whatsapp, 4))


def candidate_business(shop: Column, page: Column, quotes: Column, pairs: Column, phone: Column, address: Column, social: Column, kind: Column, country: Column) -> Column:
    near = country.isin(*"Armenia Germany Iran Qatar Turkey UAE UK".split())
    return percent(one(shop, 25) + one(page, 20) + most(quotes * 4, 20) + most(pairs * 5, 15) + one(phone, 8) + one(address, 8) + one(social, 7) + one(kind == "remittance_exchange", 6) + one(near, 6))


def candidate_uae(kind: Column, flags: dict[str, Column], parse: Column) -> Column:
    """flags: website, instagram, telegram, whatsapp, transfer, page, post, usd, aed."""
    worth = {"website": 10, "instagram": 8, "telegram": 6, "whatsapp": 8, "transfer": 10, "page": 10, "post": 8, "usd": 10, "aed": 6}
    total = parse + one(kind.isin(*SHOPS), 10)
    for name, n in worth.items():
        total = total + one(flags[name], n)
    return percent(total)


def source_category(channel_type: Column, shop: Column, ranked_kind: Column) -> Column:
    kind, low = F.lower(F.trim(ranked_kind)), F.lower(F.trim(channel_type))
    return (
        F.when(kind == "exchange_shop", "direct_shop").when(kind.isin("settlement_exchange", "regional_market_channel", "aggregator"), kind).when(shop | (low == "individual_exchange_shop"), "direct_shop")
        .when(low.contains("market"), "market_channel").when(low.contains("dealer"), "regional_market_channel").when(low.contains("aggregator"), "aggregator").otherwise("unknown")
    )


CROSS = dict(zip("AMD EUR GBP IQD QAR TRY".split(), (390.0, 1.14, 1.30, 1310.0, 3.64, 45.18)))
HOME = dict(zip("AMD EUR GBP IQD QAR TRY".split(), "Armenia Germany UK Iraq Qatar Turkey".split()))


def comparable_rial(value: Column, currency: Column, country: Column) -> Column:
    """Rial per dollar that a quote in another currency stands for; only in that currency's own country."""
    out = F.when(currency == "USD", value).when(currency == "AED", value * 3.6725)
    for c, home in HOME.items():
        out = out.when((currency == c) & (country == home), value / CROSS[c] if c in ("GBP", "EUR") else value * CROSS[c])
    return out


def per_hundred(value: Column, currency: Column, said: Column) -> Column:
    """Dinar quotes for a hundred, as the text says, per one."""
    hundred = F.lower(said).rlike("(صد|یکصد|100) (دینار|دينار)")
    return F.when((currency == "IQD") & hundred, value / 100).otherwise(value)
