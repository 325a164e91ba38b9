"""Values, links, names and counts out of pages and of the messages that a page shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.functions import numbers, text

RATE_PAGES = tuple("rate rates price prices exchange currency نرخ قیمت".split())
MONEY = tuple("درهم aed دلار usd تومان irr".split())
SHOWN = ("dataValue", "dataPrice", "value", "content", "text")


def first_positive(*values: Column) -> Column:
    """The first value above 0, in the order given."""
    return F.coalesce(*[F.when(v > 0, v.cast("double")) for v in values])


def selected(entries: Column, low: float, high: float) -> Column:
    """The first number within the bounds among what an array of structs of SHOWN has, entry by entry and field by field."""
    inside = lambda v: F.when(v.between(low, high), v)
    each = F.transform(entries, lambda e: F.coalesce(*[inside(numbers.first_number(e[f])) for f in SHOWN]))
    return F.get(F.filter(each, lambda v: v.isNotNull()), F.lit(0))


def near_hint(page: Column, hints: tuple[str, ...], low: float, high: float) -> Column:
    """The number within the bounds that stands up to 40 characters after a hint, else up to 20 before it; the first hint that has one."""
    t = numbers.western_digits(page)
    n = r"([0-9][0-9,٬،.]{2,})"
    picks = []
    for h in hints:
        for p in (rf"(?i)\Q{h}\E[^0-9]{{0,40}}{n}", rf"(?i){n}[^0-9]{{0,20}}\Q{h}\E"):
            v = numbers.parse_number(F.regexp_replace(F.regexp_extract(t, p, 1), r"[.,٬،]+$", ""))
            picks.append(F.when(v.between(low, high), v))
    return F.coalesce(*picks)


def region_unit(said: Column, values: Column, candidate: Column) -> Column:
    """By keyword, else by the candidate or the upper median: from 700,000 rial, 50,000 to 350,000 toman."""
    s = F.array_sort(values)
    probe = F.coalesce(candidate, F.get(s, F.floor(F.size(s) / 2).cast("int")).cast("double"))
    return numbers.unit_of_text(said, F.when(probe >= 700_000, "rial").when(probe.between(50_000, 350_000), "toman").otherwise("unknown"))


def normalized(currencies: Column, mid: Column, sell: Column, buy: Column, benchmark: float) -> Column:
    """value and currency of a record: as dollars within .55 to 1.65 times the benchmark, else as dirham between 100,000 and 900,000; else only its first currency."""
    v = first_positive(mid, sell, buy)
    known = F.filter(F.split(currencies, r"\|"), lambda c: ~c.isin("", "UNKNOWN"))
    pick = lambda ok, name: F.when(ok, F.struct(v.alias("value"), F.lit(name).alias("currency")))
    usd = F.array_contains(known, "USD") & v.between(benchmark * 0.55, benchmark * 1.65)
    aed = F.array_contains(known, "AED") & v.between(100_000, 900_000)
    return F.coalesce(pick(usd, "USD"), pick(aed, "AED"), F.struct(F.lit(None).cast("double").alias("value"), F.coalesce(F.get(known, F.lit(0)), F.lit("UNKNOWN")).alias("currency")))


def rate_pages(base: Column, html: Column, most: int = 3) -> Column:
    """The root of a site, unless that is the page itself, and its links of the same domain that speak of rates, in order, up to most."""
    root = F.concat(F.regexp_extract(base, "^([a-z]+)://", 1), F.lit("://"), text.domain_of(base), F.lit("/"))
    absolute = F.transform(text.links_of(html), lambda x: F.when(x.rlike("^https?://"), x).when(x.startswith("//"), F.concat(F.lit("https:"), x)).when(x.startswith("/"), F.concat(F.regexp_extract(base, "^([a-z]+://[^/]+)", 1), x)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), x)))
    sites = F.filter(F.array_distinct(F.filter(absolute, lambda x: (text.domain_of(x) == text.domain_of(base)) & text.contains_any(F.regexp_replace(x, "^[a-z]+://[^/]+", ""), RATE_PAGES))), lambda x: x != base)
    return F.slice(F.array_distinct(F.concat(F.when(root != base, F.array(root)).otherwise(F.array().cast("array<string>")), F.transform(sites, text.website))), 1, most)


def rate_blocks(page: Column, before: int = 2, lines: int = 4, most: int = 24) -> Column:
    """Distinct runs of visible lines around each line that has a number and speaks of rates or money."""
    shown = F.filter(F.transform(F.split(text.clean_html(page), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    spoken = F.transform(shown, lambda x, i: F.when(x.rlike(r"[0-9۰-۹]") & text.contains_any(x, RATE_PAGES + MONEY), F.array_join(F.slice(shown, F.greatest(i - before + 1, F.lit(1)), F.least(i, F.lit(before)) + lines), " ")))
    return F.slice(F.array_distinct(F.array_compact(spoken)), 1, most)


def quote_counts(blocks: Column, most: int = 30) -> Column:
    """quotes and pairs among the first blocks: those with a number and a word for a rate, and of these those with two numbers and a word for a side."""
    words = ("buy", "sell", "rate", "quote", "fx", "usd", "eur", "خرید", "فروش", "نرخ", "قیمت", "دلار", "یورو")

    def one(b: Column) -> Column:
        n = F.when(text.contains_any(b["low"], words, True), F.size(numbers.number_tokens(b["t"], True))).otherwise(0)
        return F.struct(n.alias("n"), text.contains_any(b["low"], ("buy", "sell", "خرید", "فروش"), True).alias("side"))

    # a block without a digit has no number; each step is worked out once
    western = F.filter(F.transform(F.slice(blocks, 1, most), numbers.western_digits), lambda b: b.rlike("[0-9]{3}"))
    told = F.transform(F.transform(western, lambda b: F.struct(b.alias("t"), F.lower(b).alias("low"))), one)
    whole = ~F.exists(F.slice(blocks, 1, most), lambda b: b.isNull())
    count = lambda x, f: F.when(whole, F.size(F.filter(x, f)))
    return F.transform(F.array(told), lambda x: F.struct(count(x, lambda b: b["n"] > 0).alias("quotes"), count(x, lambda b: (b["n"] >= 2) & b["side"]).alias("pairs")))[0]


def name_of(title: Column, meta: Column, url: Column, links: Column) -> Column:
    """A business's name: its title or description without what follows a bar, else its domain's label, else its handle, else the address."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s+\|\s+.*$", ""))
    label = F.initcap(F.translate(F.regexp_extract(text.domain_of(url), r"^([^.]+)", 1), "-_", "  "))
    handle = F.get(F.filter(F.transform(links, lambda x: F.regexp_extract(x, r"instagram\.com/([A-Za-z0-9_.]+)", 1)), lambda x: x != ""), F.lit(0))
    return F.coalesce(*[F.when(F.length(bare(c)) >= 4, bare(c)) for c in (title, meta)], F.nullif(label, F.lit("")), F.translate(handle, "_.", "  "), url)


def survey_keeps(quotes: Column, parse: Column, shop: Column, kind: Column, status: Column) -> Column:
    """Channels that a survey goes on with, and the points by which they are ordered."""
    network = kind.isin("dealer_network_channel", "market_price_channel")
    keep = ((quotes > 0) | (parse >= 50) | shop | (network & (parse >= 35))) & ~F.coalesce(status.startswith("error"), F.lit(False))
    return F.when(keep, parse + quotes * 4 + F.when(shop, 14).otherwise(0) + F.when(network, 8).otherwise(0))


def point_estimate(mid: tuple[Column, ...], buy: tuple[Column, ...], sell: tuple[Column, ...], plain: tuple[Column, ...]) -> Column:
    """A sample's rate: its midpoint by the first place that has one, else that of buy and sell, else the plain value."""
    b, s = first_positive(*buy), first_positive(*sell)
    return F.coalesce(first_positive(*mid), (b + s) / 2, first_positive(*plain))
