"""Times and rates that pages show: Jalali dates, update notes, times of the day, direct rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratemill.functions import numbers, times

JALALI = dict(zip("فروردین اردیبهشت خرداد تیر مرداد شهریور مهر آبان آذر دی بهمن اسفند".split(), range(1, 13)))
GREGORIAN = dict(zip("ژانویه فوریه مارس آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر".split(), range(1, 13))) | {"آگوست": 8, "جولای": 7, "می": 5}
_TOKEN = r"(?:[0-9]{2,3}(?:[\s,٬،][0-9]{3})+|[0-9]{4,8})"
_WORDS = {"AED": "درهم|aed", "USD": "دلار|usd"}


def _month(name: Column, names: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _any(names: dict[str, int]) -> str:
    return "(" + "|".join(sorted(names, key=len, reverse=True)) + ")"


def hhmm(t: Column) -> Column:
    """Minutes of the day of HH:MM; NULL for anything else."""
    s = F.trim(t)
    part = lambda x, k: F.get(x, F.lit(k)).try_cast("int")
    minutes = lambda x: F.when((part(x, 0) <= 23) & (part(x, 1) <= 59), part(x, 0) * 60 + part(x, 1))
    return _bound(F.split(F.regexp_extract(s, "^([0-9]{2}:[0-9]{2})$", 1), ":"), minutes)


def history_time(html: Column) -> Column:
    """Noon in Tehran of the latest Jalali date in a table's cells, in UTC."""
    found = F.regexp_extract_all(numbers.western_digits(html), F.lit(r"(?is)<td>\s*(14[0-9]{2}\s*/\s*[0-9]{1,2}\s*/\s*[0-9]{1,2})\s*</td>"), F.lit(1))
    part = lambda x, k: F.trim(F.get(x, F.lit(k))).try_cast("int")
    numbered = F.transform(F.transform(found, lambda s: F.split(s, "/")), lambda x: F.struct(part(x, 0).alias("y"), part(x, 1).alias("m"), part(x, 2).alias("d")))
    days = F.transform(numbered, lambda x: times.jalali_to_date(x["y"], x["m"], x["d"]))
    return F.array_max(F.array_compact(days)).cast("timestamp") + F.expr("INTERVAL '8:30' HOUR TO MINUTE")


def profile_time(html: Column, sampled: Column) -> Column:
    """The time of the last rate that a profile shows, on the day that it shows (the year nearest to sampled) or on that of sampled in
    Tehran; a day earlier if that is over ten minutes ahead. In UTC."""
    return _bound(numbers.western_digits(html), lambda t: _profile_time(t, sampled))


def _profile_time(t: Column, sampled: Column) -> Column:
    clock = r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*<"
    label = r"\s*".join("زمان ثبت آخرین نرخ".split())
    cell = r"<td[^>]*>\s*"
    patterns = ("(?is)" + cell + label + r"\s*</td>\s*" + cell + clock, r"(?is)tgju-widget-up-i[^>]*>\s*" + clock)

    def of_day(parts: Column) -> Column:
        h, m, s = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
        s = F.coalesce(s, F.lit(0))
        return F.when((h <= 23) & (m <= 59) & (s <= 59), h * 3600 + m * 60 + s)

    seconds = F.coalesce(*[_bound(F.split(F.regexp_extract(t, p, 1), ":"), of_day) for p in patterns])
    days = "|".join([*(k + "شنبه" for k in ("پنج", "چهار", r"سه[\s\x{200c}]*", "دو", "یک", "")), "جمعه"])
    weekday = rf"(?is)(?:{days})\s+([0-9]{{1,2}}\s+\p{{L}}+)\s*[-–]"
    shift = F.expr("INTERVAL '3:30' HOUR TO MINUTE")
    here = sampled + shift
    day_and_month = lambda x: F.struct(F.get(x, F.lit(0)).try_cast("int").alias("d"), _month(F.get(x, F.lit(1)), JALALI).alias("m"))
    told = _bound(F.split(F.regexp_extract(t, weekday, 1), r"\s+"), day_and_month)
    nearest = _bound(told, lambda x: F.when(x["m"].isNotNull(), times.nearest_jalali(x["d"], x["m"], sampled)))
    date = F.coalesce(nearest, here.cast("date"))
    local = date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return _bound(local, lambda x: F.when(x > here + F.expr("INTERVAL 10 MINUTES"), x - F.expr("INTERVAL 1 DAY")).otherwise(x)) - shift


def _clock(t: Column) -> Column:
    """Minutes of a time of the day that may say before or after noon; 0 without one."""
    h, m = F.regexp_extract(t, "([0-9]{1,2})[:：]([0-9]{2})", 1).try_cast("int"), F.regexp_extract(t, "([0-9]{1,2})[:：]([0-9]{2})", 2).try_cast("int")
    late, early = t.rlike(r"(?i)ب\.ظ|pm"), t.rlike(r"(?i)ق\.ظ|am")
    h = F.when(late & (h < 12), h + 12).when(early & (h == 12), 0).otherwise(h)
    return F.when((h <= 23) & (m <= 59), h * 60 + m).otherwise(0)


def update_time(text: Column) -> Column:
    """The time of an update that a text tells by a Jalali date, else by a Gregorian one in Persian; as it is shown."""
    t = numbers.western_digits(text)
    clock = r"(?:[^0-9]{0,60}([0-9]{1,2}[:：][0-9]{2}(?:\s*(?:ق\.ظ|ب\.ظ|am|pm))?))?"
    picks = []
    for names, date_of in ((JALALI, times.jalali_to_date), (GREGORIAN, lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d"))):
        for first in ("day", "month"):
            p = rf"(?iu)([0-9]{{1,2}})\s+{_any(names)}\s+([0-9]{{4}}){clock}" if first == "day" else rf"(?iu){_any(names)}\s+([0-9]{{1,2}})\s*,?\s*([0-9]{{4}}){clock}"
            d, m = (1, 2) if first == "day" else (2, 1)
            date = date_of(F.regexp_extract(t, p, 3).try_cast("int"), _month(F.regexp_extract(t, p, m), names), F.regexp_extract(t, p, d).try_cast("int"))
            picks.append(date.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), _clock(F.regexp_extract(t, p, 4))))
    return F.coalesce(*picks)


def direct_unit(value: Column, text: Column, currency: str) -> Column:
    """toman or rial by keyword, else by what is usual for the currency; NULL beyond."""
    low = F.lower(text)
    toman, rial = ((15_000, 90_000), (150_000, 900_000)) if currency == "AED" else ((50_000, 350_000), (500_000, 3_500_000))
    return F.when(low.rlike("ریال|rial|irr"), "rial").when(low.rlike("تومان|toman|tmn"), "toman").when(value.between(*toman), "toman").when(value.between(*rial), "rial")


def _told(t: Column, money: str) -> Callable[[Column], Column]:
    def struct(v: Column) -> Column:
        unit = direct_unit(v, t, money)
        return F.struct(F.lit(money).alias("currency"), v.alias("value"), unit.alias("unit"), F.when(unit == "toman", v * 10.0).otherwise(v.cast("double")).alias("rial"))

    return struct


def _within(low: float, high: float) -> Callable[[Column], Column]:
    return lambda r: r["unit"].isNotNull() & r["rial"].between(low, high)


def direct_rates(block: Column, benchmark: float) -> Column:
    """currency, value, unit and rial of each rate that a block of a page tells, each once: after words for a rate and a currency,
    after the currency, or before it; within .55 to 1.65 times the benchmark as dollars."""
    t = numbers.western_digits(block)
    low, high = (benchmark * 0.55, benchmark * 1.65) if benchmark > 0 else (500_000.0, 2_500_000.0)
    found = []
    for money, words in _WORDS.items():
        peg = 3.6725 if money == "AED" else 1.0
        here = r"[^.!?\n]"  # what doesn't end a sentence
        told_of = "|".join(("امروز", "تبدیل", "حواله", "قیمت", "نرخ"))
        unit = "|".join(("rial", "irr", "ریال", "تومان"))
        for p in (rf"(?:{told_of}){here}{{0,80}}(?:{words})[^0-9]{{0,50}}({_TOKEN})", rf"(?:{words}){here}{{0,90}}?({_TOKEN})", rf"({_TOKEN})\s*(?:{unit}){here}{{0,50}}(?:{words})"):
            p = "(?iu)" + p
            values = F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda s: F.regexp_replace(s, "[^0-9]", "").try_cast("bigint"))

            found.append(F.filter(F.transform(values, _told(t, money)), _within(low / peg, high / peg)))
    return F.array_distinct(F.flatten(F.array(*found)))
