"""Classes, reasons and gates of sources, channels and records. Each ladder belongs to another survey; they differ on purpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.functions import extraction, numbers, text


def _list(words: str) -> tuple[str, ...]:
    return tuple(w.strip() for w in words.split(";"))


HOME_CITIES = _list("Ahvaz; BandarAbbas; Isfahan; Karaj; Kerman; Mashhad; Qom; Rasht; Shiraz; Tabriz; Tehran")
ABROAD_CITIES = _list("London; Hamburg; Frankfurt; Istanbul; Dubai")
PLACES = {
    "Iran": _list("tehran; تهران; mashhad; مشهد; isfahan; اصفهان; shiraz; شیراز; tabriz; تبریز; karaj; کرج; qom; قم; ahvaz; اهواز; rasht; رشت; kerman; کرمان"),
    "UAE": _list("dubai; دبی; دوبی; uae; امارات"), "Turkey": _list("istanbul; استانبول; turkey; turkish; ترکیه"), "Iraq": _list("sulaymaniyah; sulaimaniyah; سلیمانیه; سليمانية; iraq; عراق"),
    "Afghanistan": _list("herat; هرات; afghanistan; افغانستان"), "UK": _list("london; لندن; uk; england; britain; انگلستان"), "Germany": _list("frankfurt; فرانکفورت; hamburg; هامبورگ; germany; deutschland; آلمان"),
    "Qatar": _list("doha; دوحه; qatar; قطر; qar; ریال قطر; ريال قطر"), "Armenia": _list("yerevan; ایروان; armenia; ارمنستان; amd; درام ارمنستان"),
}
BLOCKS = _list("blocked; captcha; turnstile; access denied; attention required; automated queries; cf-chl; cf_clearance; g-recaptcha; hcaptcha; verify you are human")
NEWS = _list("خبر; اخبار; تحلیل; analysis; breaking; news")
READY = ("ready_for_research_ingestion", "monitor_only")
MARKETS = ("dealer_network_channel", "market_price_channel")
#: Dirham per dollar.
PEG = 3.6725
LOW, HIGH = 500_000.0, 5_000_000.0


def _has(t: Column, words: str) -> Column:
    return text.contains_any(t, _list(words))


def _hits(t: Column, words: Sequence[str]) -> Column:
    """How many of the words occur."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(t.contains(w), 1).otherwise(0)
    return total


# Classes


def place_of(title: Column, handle: Column, country: Column, city: Column) -> Column:
    """The place whose words a source's name has most often, the first of equals; else its city, else its country, if they are places themselves."""
    t = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(handle, F.lit("")))
    best = text.best_alias(t, {k: v for k, v in PLACES.items()}, "")
    known = lambda c: F.when(F.trim(c).isin(*PLACES), F.trim(c))
    return F.coalesce(F.nullif(best, F.lit("")), known(city), known(country), F.lit("unknown"))


def channel_type(t: Column, quotes: Column, contact: Column, city: Column, linked: Column) -> Column:
    many = quotes >= 4
    return (
        F.when(many & _has(t, "dealer; شبکه; همکار; عمده; معامله گر; تلگرامی صرافان"), "dealer_network_channel")
        .when(many & contact & (city != "unknown"), "individual_exchange_shop")
        .when((linked >= 8) & (quotes <= 3), "aggregator")
        .when(many & _has(t, "news; quotes; price channel; تحلیل; سیگنال; اخبار ارز; نرخ لحظه ای"), "aggregator")
        .when(many, "market_price_channel")
        .otherwise("unclear")
    )


def quote_origin(t: Column, shop: Column, kind: Column) -> Column:
    network = _has(t, "market; channel; dealer; بازار; کانال; همکار; شبکه")
    return F.when(shop & ~network, "direct_shop_quote").when(network | kind.isin(*MARKETS), "network_market_quote").when(_has(t, "exchange; phone; whatsapp; تماس; آدرس; صرافی"), "direct_shop_quote").otherwise("unclear")


def source_bucket(shop: Column, kind: Column, city: Column) -> Column:
    at_home = F.when(F.trim(city).isin(*ABROAD_CITIES), "diaspora_shop").otherwise("direct_shop")
    return F.when(shop, at_home).when(kind == "dealer_network_channel", "network_channel").when(kind.isin("aggregator", "market_price_channel"), "market_channel").when(kind == "individual_exchange_shop", at_home).otherwise("unclear")


def basket_of(shop: Column, kind: Column, abroad: Column) -> Column:
    direct = F.when(abroad, "diaspora_direct_shop").otherwise("inside_iran_direct_shop")
    return F.when(shop | (kind == "individual_exchange_shop"), direct).when(kind == "dealer_network_channel", "network_channel").when(kind.isin("aggregator", "market_price_channel"), "market_channel").otherwise("unclear")


def board_type(places: Column, rich: Column, shop: Column, t: Column) -> Column:
    """places: distinct ones named; rich: messages of two and more numbers among the first twenty."""
    return (
        F.when((places >= 3) & (rich >= 3), "regional_fx_board")
        .when((places >= 2) & (rich >= 2), "regional_market_channel")
        .when(shop | _has(t, "address; whatsapp; contact; آدرس; تماس; صرافی"), "exchange_shop")
        .when(text.contains_any(t, NEWS), "aggregator")
        .when((places >= 1) & (rich >= 1), "regional_market_channel")
        .otherwise("unknown")
    )


def signal_type(guess: Column, t: Column) -> Column:
    """By what the source was taken for, else by what it says."""
    low = F.lower(t)
    trade = _has(low, "rate; gbp; qar; amd; خرید; فروش; نرخ; قیمت; پوند; درام; ریال قطر")
    near = _hits(low, _list("armenia; doha; dubai; herat; istanbul; qatar; sulaymaniyah; yerevan; ارمنستان; ایروان; تهران; دبی; سلیمانیه; قطر; هرات"))
    return (
        F.when(guess.isin("exchange_shop", "individual_exchange_shop"), "exchange_shop").when(guess == "settlement_channel", "settlement_channel")
        .when(guess.isin("regional_market_channel", *MARKETS), "regional_market_channel").when(guess == "aggregator", "aggregator")
        .when(trade & _has(low, "exchange; sarafi; صرافی"), "exchange_shop").when(_has(low, "transfer; remittance; settlement; حواله; پرداخت"), "settlement_channel")
        .when(near >= 2, "regional_market_channel").when(_has(low, "aggregator; analysis; اخبار"), "aggregator").otherwise("unknown")
    )


_ROUTE = _list("armenia; doha; dubai; herat; istanbul; qatar; sulaymaniyah; tehran; yerevan")
_PARTNERS = _list("Afghanistan; Armenia; Germany; Iraq; Qatar; Turkey; UAE; UK")


def multilingual_type(t: Column, quotes: Column, country: Column, phone: Column, address: Column) -> Column:
    shop, contact = _has(t, "exchange; sarafi; wechselstube; geldwechsel; döviz bürosu; صرافی; صرافة"), phone | address
    market = _has(t, "market; dealer; regional; tehran; herat; dubai; istanbul; sulaymaniyah; نرخ; قیمت; بازار ارز")
    return (
        F.when(shop & contact, "exchange_shop")
        .when(_has(t, "settlement; remittance; money transfer; geldtransfer; para transferi; حواله; تحويل") & country.isin(*_PARTNERS), "settlement_exchange")
        .when((quotes >= 3) & text.contains_any(t, _ROUTE), "regional_market_channel")
        .when(_has(t, "news; signal; analysis; price board; تحلیل; سیگنال; اخبار") | ((quotes >= 3) & market & ~contact), "aggregator")
        .when(shop, "exchange_shop")
        .otherwise("unknown")
    )


def business_type(t: Column, country: Column, quotes: Column, phone: Column, address: Column) -> Column:
    rates = _has(t, "buy; sell; rate; quote; fx; usd; eur; خرید; فروش; نرخ; قیمت; دلار; یورو")
    near = _hits(F.lower(t), _list("dubai; herat; istanbul; sulaymaniyah; tehran; تهران; دبی; سلیمانیه; هرات; استانبول"))
    return (
        F.when(_has(t, "exchange; sarafi; wechselstube; doviz; döviz; صرافی") & (phone | address | rates), "exchange_shop")
        .when(_has(t, "hawala; remittance; settlement; cash transfer; money transfer; geldtransfer; para transferi; حواله; تحويل") & country.isin(*_PARTNERS), "remittance_exchange")
        .when((quotes >= 3) & (near >= 2), "regional_market_channel")
        .otherwise("unknown")
    )


def emirates_type(t: Column, whatsapp: Column, telegram: Column, instagram: Column, rate_posts: Column, transfer_hint: Column) -> Column:
    rates = _has(t, "buy; sell; rate; quote; usd; eur; aed; خرید; فروش; نرخ; قیمت; دلار; یورو; درهم")
    sends = _has(t, "hawala; remittance; settlement; transfer; حواله; تحويل")
    return (
        F.when(_has(t, "exchange; sarafi; صرافی; صرافة") & (rates | whatsapp | telegram | instagram), "exchange_shop")
        .when(transfer_hint & (sends | whatsapp), "remittance_exchange").when(sends, "settlement_exchange").when(rate_posts >= 3, "regional_market_signal").otherwise("unknown")
    )


def surface_type(exchange: Column, remit: Column, rate: Column, city: Column) -> Column:
    return F.when(exchange & rate, "exchange_shop").when(remit & city.isin("Baghdad", "Erbil", "Sulaymaniyah"), "remittance_exchange").when(rate, "regional_market_channel").otherwise("unknown")


def quote_density(messages: Column, places: Column) -> Column:
    """0 to 100 over the first twenty of an array of messages; places: an array of how many places each names."""
    first = F.slice(F.arrays_zip(messages.alias("m"), places.alias("p")), 1, 20)
    words = _list("board; تابلو; نرخ; قیمت; بازار; لحظه ای")

    def points(x: Column) -> Column:
        low = F.lower(numbers.western_digits(x["m"]))
        n = F.size(F.regexp_extract_all(low, F.lit(r"(?<![0-9])(?:[0-9]{1,3}(?:[\s,٬،][0-9]{3})+|[0-9]{5,8})(?![0-9])"), F.lit(0)))
        return F.when(n >= 2, 10).otherwise(0) + F.when(x["p"] >= 2, 15).otherwise(0) + F.when(text.contains_any(low, words, True), 5).otherwise(0)

    return F.least(F.lit(100), F.aggregate(first, F.lit(0), lambda s, x: s + points(x)))


def card_freshness(status: Column, reason: Column, state: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin("fresh", "recent", "stale", "old"), s).when(F.lower(reason).contains("stale"), "old").when(state == "publish", "recent").when(state == "monitor", "stale").otherwise("unknown")


def watch_signal(dollar: Column, dirham: Column, remittance: Column) -> Column:
    return F.when(dollar & dirham, "website_rate_board").when(remittance, "remittance_quote").when(dollar | dirham, "numeric_quote_page").otherwise("stale_public_signal")


def research_confidence(n: Column, dispersion: Column, concentration: Column, dominated: Column) -> Column:
    loose = concentration != "high"
    return F.when((n >= 80) & dispersion.isin("low", "medium") & loose & ~dominated, "high").when((n >= 35) & (dispersion != "high") & loose, "medium").otherwise("low")


def next_step(confidence: Column, delta_pct: Column) -> Column:
    """What to do next, as a key of NEXT_STEPS."""
    return F.when((confidence == "high") & (F.abs(delta_pct) <= 1.5), "persist").when(confidence == "high", "backtest").when(confidence == "medium", "collect").otherwise("expand")


NEXT_STEPS = {
    "persist": "keep a standing feed of the ready channels, with those on watch as a second check", "backtest": "test seven days on a rolling base before a standing feed",
    "collect": "collect daily for two to three weeks and weigh channels more tightly first", "expand": "find more direct shops, and fresher, better formed records first",
}


def coherence(n: Column, cv: Column, top: Column, effective: Column, fresh: Column, structure: Column) -> Column:
    """0 to 100: records, spread, concentration, effective channels, freshness, structure."""
    falling = lambda v, a, b, most: F.when(v.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - v) / (b - a))) * most)
    total = F.least(F.lit(1.0), n / 30.0) * 25.0 + falling(cv, 0.03, 0.20, 25.0) + falling(top, 0.20, 0.60, 20.0)
    total = total + F.when(effective.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (effective - 2.0) / 6.0)) * 15.0)  # least() skips NULL
    total = total + F.least(F.lit(1.0), fresh / 85.0) * 20.0 + F.least(F.lit(1.0), structure / 90.0) * 15.0
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def stability(score: Column, n: Column, cv: Column, top: Column) -> Column:
    return F.when((score >= 70) & (n >= 20) & (cv <= 0.12) & (top <= 0.35), "benchmark_candidate").when((score >= 50) & (n >= 10), "shadow_diagnostic_feed").otherwise("monitor_only_signal")


def ranking_role(n: Column, quality: Column, structure: Column, share: Column) -> Column:
    return F.when((n >= 8) & (quality >= 70) & (structure >= 80) & (share <= 0.35), "benchmark_support").when((n >= 4) & (quality >= 60), "shadow_diagnostic").otherwise("monitor_only_signal")


# Gates and reasons


def _paired(buy: Column, sell: Column) -> Column:
    return F.coalesce((buy > 0) & (sell > 0), F.lit(False))


def research_reason(status: Column, currency: Column, keep: Column, quality: Column, least: float, mid: Column, mid_rial: Column, buy: Column, sell: Column, structure: Column) -> Column:
    """The first reason to leave a record out, in order; ok if there is none."""
    weak = ~_paired(buy, sell) & ~F.coalesce(mid.isNotNull() & (structure >= 72) & (quality >= 70), F.lit(False))
    return (
        F.when(~F.coalesce(status.isin(*READY), F.lit(False)), "status_excluded").when(~F.array_contains(F.split(F.trim(currency), r"\|"), "USD"), "non_usd").when(~F.coalesce(keep, F.lit(False)), "duplicate")
        .when(F.coalesce(quality, F.lit(0.0)) < least, "low_quality").when(F.coalesce(mid_rial, F.lit(0.0)) <= 0, "no_numeric").when(weak, "midpoint_only_weak").otherwise("ok")
    )


def rescued_rial(mid: Column, mid_rial: Column) -> Column:
    """A midpoint that was left in toman, times ten."""
    return F.when((mid_rial < LOW) & mid.between(50_000, 500_000), mid * 10.0).otherwise(mid_rial)


def segmented_reason(status: Column, currency: Column, keep: Column, quality: Column, least: float, mid: Column, mid_rial: Column, buy: Column, sell: Column, structure: Column) -> Column:
    """As research_reason(), of rates that have to be plausible after rescued_rial()."""
    weak = ~_paired(buy, sell) & ~F.coalesce((structure >= 72) & (quality >= 70), F.lit(False))
    return (
        F.when(~F.coalesce(status.isin(*READY), F.lit(False)), "status_excluded").when(~F.array_contains(F.split(F.trim(currency), r"\|"), "USD"), "non_usd").when(~F.coalesce(keep, F.lit(False)), "duplicate")
        .when(F.coalesce(quality, F.lit(0.0)) < least, "low_quality").when(F.coalesce(mid_rial, F.lit(0.0)) <= 0, "no_numeric_midpoint")
        .when(~rescued_rial(mid, mid_rial).between(LOW, HIGH), "out_of_plausible_range").when(weak, "weak_midpoint_only").otherwise("ok")
    )


def row_rate(mid_rial: Column, sell_rial: Column, buy_rial: Column, mid: Column, unit: Column) -> Column:
    """rate and basis: the first positive of the rial midpoint, sell and buy, else the plain midpoint by its unit."""
    own = mid * F.when(F.lower(F.trim(unit)) == "toman", 10.0).otherwise(1.0)
    some = lambda v, name: F.when(v > 0, F.struct(v.cast("double").alias("rate"), F.lit(name).alias("basis")))
    return F.coalesce(some(mid_rial, "midpoint"), some(sell_rial, "sell"), some(buy_rial, "buy"), some(own, "inferred"), F.struct(F.lit(None).cast("double").alias("rate"), F.lit("unusable").alias("basis")))


def dollar_rate_in(t: Column, unit: Column, low: Column, high: Column) -> Column:
    """rate and basis from the 80 characters after each word for the dollar: two numbers within 18 % of each other, else one; within the bounds."""
    western = numbers.western_digits(t)
    factor = F.when(numbers.unit_of_text(western, unit) == "toman", 10.0).otherwise(1.0)
    number = lambda a, k: F.regexp_replace(F.get(a, F.lit(k)), "[^0-9]", "").try_cast("double")
    picks = []
    for word in ("دلار آمریکا", "دلار", "usd"):
        after = F.slice(F.split(F.lower(western), rf"\Q{word}\E"), 2, 1_000)

        def look(part: Column) -> Column:
            found = F.regexp_extract_all(F.substring(part, 1, 80), F.lit(extraction.TOKEN), F.lit(0))
            one, two = number(found, 0) * factor, number(found, 1) * factor
            near = (F.abs(one - two) / F.greatest(one, two) <= 0.18) & ((one + two) / 2).between(low, high)
            return F.when(near, F.struct(((one + two) / 2).alias("rate"), F.lit("midpoint").alias("basis"))).when(one.between(low, high), F.struct(one.alias("rate"), F.lit("inferred").alias("basis")))

        picks.append(F.get(F.filter(F.transform(after, look), lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*picks, F.struct(F.lit(None).cast("double").alias("rate"), F.lit("unusable").alias("basis")))


def rate_bounds(benchmark: Column) -> tuple[Column, Column]:
    return F.when(benchmark > 0, benchmark * 0.55).otherwise(500_000.0), F.when(benchmark > 0, benchmark * 1.65).otherwise(2_500_000.0)


def usable_rate(status: Column, keep: Column, currency: Column, quality: Column, fresh: Column, rate: Column, found: Column, benchmark: Column) -> Column:
    """The rate of a record that may enter a basket (its own within the bounds, else the one found in its text), NULL for any other."""
    low, high = rate_bounds(benchmark)
    fits = (status.isNull() | status.isin(*READY)) & F.coalesce(keep, F.lit(False)) & currency.contains("USD") & (quality >= 60) & (fresh >= 45)
    return F.when(fits, F.coalesce(F.when((rate > 0) & rate.between(low, high), rate), F.when(found > 0, found)))


def review_rate(status: Column, currency: Column, parse: Column, raw: Column, fresh: Column, benchmark: Column) -> Column:
    """The dollar rate of a reviewed dirham or dollar record, NULL where it may not be used."""
    low, high = rate_bounds(benchmark)
    money = F.upper(F.trim(currency))
    aed = F.when(raw * PEG >= low, F.when(raw * PEG <= high, raw * PEG))
    usd = F.when(parse >= 70, F.when(raw.between(F.when(benchmark > 0, benchmark * 0.78).otherwise(1_000_000.0), F.when(benchmark > 0, benchmark * 1.35).otherwise(2_000_000.0)), raw))
    return F.when(F.trim(status).isin("publishable", "monitor_only") & (parse >= 50) & (raw > 0) & (fresh >= 45), F.when(money == "AED", aed).when(money == "USD", usd))


def business_like(title: Column, domain_hint: Column, place_hint: Column, noise: Column, contact: Column, rates: Column, kind: Column, score: Column) -> Column:
    """A candidate that looks like a business: hints of its domain and title, contact, rates, score. noise: its domain or title is one of news and converters."""
    known = kind.isin("exchange_shop", "remittance_exchange", "settlement_exchange")
    hint = _has(title, "exchange; remittance; settlement; money transfer; صرافی; حواله; انتقال پول")
    return ~noise & ((kind != "unknown") | contact) & (contact | domain_hint) & (place_hint | domain_hint) & (rates | contact) & ((score >= 40) | contact) & (known | (hint & contact))


def stays(domain_excluded: Column, kind: Column, likely: Column) -> Column:
    """Records that a survey keeps. What is of no known kind has to be a likely shop, whatever its score."""
    return ~domain_excluded & ((kind != "unknown") | likely)


def active_source(platform: Column, families: Column, seen: Column, best: Column, of: str, wanted: tuple[str, ...]) -> Column:
    """A registry's source of a platform and one of the families that was useful once. families: joined by bars or commas."""
    ours = F.arrays_overlap(text.tokens(families), F.array(*[F.lit(w) for w in wanted]))
    return (F.lower(platform) == of) & ours & (F.coalesce(seen != "", F.lit(False)) | (best > 0))


def direct_shop(phone: Column, address: Column, on_map: Column, named: Column, city: Column, quotes: Column, pairs: Column, parse: Column, commentary: Column) -> Column:
    """Four of seven signs, or one of two ladders of a named shop; never where commentary prevails."""
    home = city.isin(*HOME_CITIES)
    signs = sum((F.when(c, 1).otherwise(0) for c in (phone, address, on_map, named, home, pairs >= 2, quotes >= 4)), F.lit(0))
    reach = phone | address | on_map
    return ~commentary & ((signs >= 4) | (named & home & (quotes >= 4) & (parse >= 45)) | (named & reach & (parse >= 10)))


def rejection_reason(commentary: Column, quotes: Column, pairs: Column, parse: Column, named: Column, city: Column, reach: Column) -> Column:
    return (
        F.when(commentary, "commentary_heavy").when((quotes < 3) & (pairs < 2), "too_few_quote_posts").when(parse < 45, "low_parseability").when(~named, "missing_shop_identity")
        .when(~city.isin(*HOME_CITIES) & ~reach, "not_inside_iran_or_contactable").otherwise("monitor_only")
    )


def bot_block(html: Column) -> Column:
    return text.contains_any(html, BLOCKS)


def commentary_heavy(hits: Column, shop_hits: Column, contact: Column) -> Column:
    """Commentary prevails if it is told of often, more than what makes a shop, and nobody can be reached."""
    return (hits >= F.greatest(F.lit(3.0), shop_hits * 1.2)) & ~contact


def primary_currency(currencies: Column) -> Column:
    """The first of an order of preference that an array has."""
    ladder = F.lit(None).cast("string")
    for c in ("AMD", "QAR", "GBP", "EUR", "AED", "USD"):
        ladder = F.when(F.array_contains(currencies, c), c).otherwise(ladder)
    return F.coalesce(ladder, F.lit("UNKNOWN"))


def place_label(place: Column, state: Column) -> Column:
    """Whether a place's card shows a rate, a watched signal or nothing."""
    return F.when(state == "publish", F.concat(place, F.lit(" market rate"))).when(state == "monitor", F.concat(place, F.lit(" signal on watch"))).otherwise(F.concat(place, F.lit(" without signal")))
