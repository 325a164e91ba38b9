"""Rates that stand next to a place or a keyword in a text: pairs, single values, differences to another place; units; region windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.functions import numbers

TOKEN = r"(?:[0-9]{2,3}(?:[،٬,\s][0-9]{3})+|[0-9]{4,8})"
SIGNED = r"[+-]\s*[0-9]{1,6}(?:[,\s][0-9]{3})?"
LEAST = 10_000


def any_of(aliases: tuple[str, ...]) -> str:
    """A pattern for the aliases, the longest first."""
    return "(?:" + "|".join(rf"\Q{a.lower()}\E" for a in sorted(set(aliases), key=lambda a: (-len(a), a))) + ")"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _number(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "").try_cast("double")


def _low(text: Column) -> Column:
    return F.lower(numbers.western_digits(text))


def pair_for(text: Column, aliases: tuple[str, ...], lowered: bool = False) -> Column:
    """first, second and mid of the first a/b after a place, else before it; both at least LEAST. lowered: the text is in lower
    case with western digits already, here as below."""
    low, at = text if lowered else _low(text), any_of(aliases)
    out = []
    for p in (rf"{at}[^0-9\n]{{0,32}}({TOKEN})\s*[/\\|-]\s*({TOKEN})", rf"({TOKEN})\s*[/\\|-]\s*({TOKEN})[^0-9\n]{{0,32}}{at}"):
        both = F.struct(_number(F.regexp_extract(low, p, 1)).alias("a"), _number(F.regexp_extract(low, p, 2)).alias("b"))
        out.append(_once(both, lambda x: F.when((x["a"] >= LEAST) & (x["b"] >= LEAST), F.struct(x["a"].alias("first"), x["b"].alias("second"), ((x["a"] + x["b"]) / 2).alias("mid")))))
    return F.coalesce(*out)


def single_for(text: Column, aliases: tuple[str, ...], lowered: bool = False) -> Column:
    """The number after a place on its line, else on the next."""
    low, at = text if lowered else _low(text), any_of(aliases)
    values = [_number(F.regexp_extract(low, p, 1)) for p in (rf"{at}[^0-9+\n-]{{0,28}}({TOKEN})", rf"{at}[^+0-9-]{{0,14}}\n[\s]*({TOKEN})")]
    return F.coalesce(*[_once(v, lambda x: F.when(x >= LEAST, x)) for v in values])


def delta_for(text: Column, aliases: tuple[str, ...], lowered: bool = False) -> Column:
    """The signed number after a place, else before it; at least 50 either way."""
    low, at = text if lowered else _low(text), any_of(aliases)
    values = [F.regexp_replace(F.regexp_extract(low, p, 1), r"[^0-9+-]", "").try_cast("double") for p in (rf"{at}[^0-9+\n-]{{0,24}}({SIGNED})", rf"({SIGNED})[^\n0-9]{{0,12}}{at}")]
    return F.coalesce(*[_once(v, lambda x: F.when(F.abs(x) >= 50, x)) for v in values])


def signal(text: Column, place: tuple[str, ...], capital: tuple[str, ...]) -> Column:
    """kind and value of a place's rate: a pair, a single value, or the capital's rate and a difference."""
    told = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    def of(low: Column) -> Column:
        pair = _once(pair_for(low, place, True)["mid"], lambda v: F.when(v.isNotNull(), told("pair", v)))
        single = _once(single_for(low, place, True), lambda v: F.when(v.isNotNull(), told("single", v)))
        # the capital's rate is looked for only where there is a difference to add
        base = lambda d: F.when(d.isNotNull(), F.coalesce(pair_for(low, capital, True)["mid"], single_for(low, capital, True)) + d)
        relative = _once(_once(delta_for(low, place, True), base), lambda v: F.when(v > 0, told("relative", v)))
        return F.coalesce(pair, single, relative)

    return _once(_low(text), of)


def unit_by_median(text: Column, values: Column) -> Column:
    """By keyword, else by the true median: under 400,000 toman."""
    s = F.array_sort(values)
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return numbers.unit_of_text(text, F.when(n <= 0, "unknown").when(middle < 400_000, "toman").otherwise("rial"))


def unit_by_ratio(stated: Column, midpoint: Column, midpoint_rial: Column) -> Column:
    """As stated, else by how the rial value relates to the plain one, else by size."""
    ratio = F.when(midpoint > 0, midpoint_rial / midpoint)
    probe = F.coalesce(midpoint_rial, midpoint)
    return F.when(F.lower(stated).isin("toman", "rial"), F.lower(stated)).when(ratio.between(8, 12), "toman").when(ratio.between(0.8, 1.2), "rial").when(probe >= 900_000, "rial").when(probe.between(50_000, 400_000), "toman").otherwise("unknown")


def filled_rial(buy: Column, sell: Column, midpoint: Column, buy_rial: Column, sell_rial: Column, midpoint_rial: Column, unit: Column) -> Column:
    """midpoint and midpoint_rial with what is missing worked out."""
    mid = F.coalesce(midpoint, (buy + sell) / 2)
    b, s = F.coalesce(buy_rial, numbers.to_rial(buy, unit)), F.coalesce(sell_rial, numbers.to_rial(sell, unit))
    return F.struct(mid.alias("midpoint"), F.coalesce(midpoint_rial, (b + s) / 2, numbers.to_rial(mid, unit)).alias("midpoint_rial"))


def windows(text: Column, alias: str, reach: int = 40) -> Column:
    """The text around each place where an alias stands, so many characters either way."""
    at = F.filter(F.transform(F.sequence(F.lit(1), F.regexp_count(F.lower(text), F.lit(rf"\Q{alias.lower()}\E"))), lambda k: k), lambda k: k > 0)
    parts = F.split(F.lower(text), rf"\Q{alias.lower()}\E")
    ends = F.transform(at, lambda k: F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * len(alias))
    hits = F.regexp_count(F.lower(text), F.lit(rf"\Q{alias.lower()}\E"))
    return F.when(hits > 0, F.transform(ends, lambda e: F.substring(text, F.greatest(e - reach + 1, F.lit(1)), F.least(e, F.lit(reach)) + len(alias) + reach))).otherwise(F.array().cast("array<string>"))


def research_weight(base: Column, fresh: Column, structure: Column, quality: Column, readiness: Column, kind: Column, flag: Column) -> Column:
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    by_kind = F.when(kind == "direct", 1.08).when(kind == "aggregated", 0.88).when(kind == "reposted", 0.62).otherwise(0.78)
    w = base * clamp(0.45 + fresh / 150, 0.45, 1.05) * clamp(0.45 + structure / 160, 0.45, 1.05) * clamp(0.50 + quality / 140, 0.50, 1.10) * clamp(0.45 + readiness / 150, 0.45, 1.10)
    return F.round(F.greatest(F.lit(0.01), w * by_kind * F.when(flag.isNotNull() & ~flag.isin("", "none"), 0.55).otherwise(1.0)), 6)


def legacy_units(source: Column, unit: Column, values: Column, toman: tuple[str, ...]) -> Column:
    """Values of a source that once gave no unit: those it quotes in toman times ten."""
    return F.when((source == "legacy") & (unit == "unknown"), F.transform_values(values, lambda k, v: F.when(k.isin(*toman), v * 10).otherwise(v))).otherwise(values)


def only_families(values: Column, families: Column) -> Column:
    """Entries of a map whose key is one of the source's families."""
    return F.map_filter(values, lambda k, v: F.array_contains(families, k))
