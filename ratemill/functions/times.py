"""Times: flexible parsing, windows of the day, freshness, the Jalali calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """ISO 8601 with T or a blank, Z or an offset, else UTC; ten to thirteen digits are seconds, or milliseconds if large."""
    t = F.trim(text)
    digits = F.when(t.rlike("^[0-9]{10,13}$"), t.try_cast("bigint"))
    iso = F.when(t.rlike(r"^[0-9]{4}(?:-[0-9]{2}){2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"), F.replace(t, F.lit(" "), F.lit("T")).try_cast("timestamp"))
    return F.coalesce(iso, F.timestamp_seconds(F.when(digits > 10_000_000_000, F.floor(digits / 1000)).otherwise(digits)))


def parse_offset(text: Column) -> Column:
    """Minutes of a UTC offset such as +03:30."""
    m = r"^([+-])([0-9]{1,2}):([0-9]{2})$"
    t = F.trim(text)
    h, n = F.regexp_extract(t, m, 2).try_cast("int"), F.regexp_extract(t, m, 3).try_cast("int")
    return F.when((h <= 23) & (n <= 59), F.when(F.regexp_extract(t, m, 1) == "-", -1).otherwise(1) * (h * 60 + n))


def in_window(ts: Column, first_minute: int = 13 * 60 + 45, last_minute: int = 14 * 60 + 15) -> Column:
    """Whether the minute of the day lies in the window; its last minute counts whole."""
    return (F.hour(ts) * 60 + F.minute(ts)).between(first_minute, last_minute)


def fresh(quote: Column, sampled: Column, hours: int = 48) -> Column:
    """Whether a quote is at most so old; a later quote is fresh too."""
    return quote.isNotNull() & (quote >= sampled - F.make_dt_interval(F.lit(0), F.lit(hours)))


def local_time_of_day(hour: Column, minute: Column, offset_minutes: Column, sampled: Column) -> Column:
    """The UTC time of a local time of day on the local date of sampled, a day earlier if that is over 12 hours ahead."""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes)
    local = sampled + shift
    at = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), hour, minute)
    at = F.when(at > local + F.expr("INTERVAL 12 HOURS"), at - F.expr("INTERVAL 1 DAY")).otherwise(at)
    return F.when(hour.between(0, 23) & minute.between(0, 59), at - shift)


def jalali_to_date(year: Column, month: Column, day: Column) -> Column:
    """The Gregorian date of a Jalali one in the years 1200 to 1700. Days since 1600-03-20 are counted by the 33-year cycle."""
    y = year - 979
    cycle = F.floor(y / 33)
    days = 365 * y + cycle * 8 + F.floor((F.pmod(y, F.lit(33)) + 3) / 4)
    days = days + F.when(month <= 7, 31 * (month - 1)).otherwise(186 + 30 * (month - 7)) + day - 1
    return F.when(year.between(1200, 1700) & month.between(1, 12) & day.between(1, 31), F.date_add(F.lit("1600-01-01").cast("date"), (days + 79).cast("int")))


def nearest_jalali(day: Column, month: Column, sampled: Column) -> Column:
    """The date of a Jalali day and month that is nearest to the local day of sampled (UTC+03:30)."""
    here = (sampled + F.expr("INTERVAL 3 HOURS 30 MINUTES")).cast("date")
    years = F.sequence(F.year(here) - 625, F.year(here) - 618)
    # a later year is a later date, so that of equal gaps the first year has the first date
    dates = F.filter(F.transform(years, lambda y: jalali_to_date(y, month, day)), lambda d: d.isNotNull())
    return F.array_min(F.transform(dates, lambda d: F.struct(F.abs(F.datediff(d, here)).alias("gap"), d.alias("date"))))["date"]
