"""Numbers and units in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
DECIMAL = r"^[-+]?[0-9]+(\.[0-9]+)?$"
#: Two or three digits with groups of three after them, or five to eight digits.
NUMBER = r"(?<![0-9])(?:[0-9]{2,3}(?:[،٬,\s][0-9]{3})+|[0-9]{5,8})(?![0-9])"


def western_digits(text: Column) -> Column:
    return F.translate(text, EASTERN, "01234567890123456789")


def bare_number(text: Column) -> Column:
    """Western digits without separators; a number if it is like DECIMAL."""
    return F.regexp_replace(F.trim(western_digits(text)), "[,٬، ]", "")


def parse_float(text: Column) -> Column:
    """A plain decimal with optional sign and separators; NULL for anything else."""
    bare = bare_number(text)
    return F.when(bare.rlike(DECIMAL), bare.try_cast("double"))


def parse_number(text: Column) -> Column:
    """parse_float() where it is positive."""
    v = parse_float(text)
    return F.when(v > 0, v)


def first_number(text: Column) -> Column:
    """The first token of the text that is a positive number."""
    found = F.regexp_extract_all(western_digits(text), F.lit(r"[-+]?[0-9][0-9,٬،.]*(?:\.[0-9]+)?"), F.lit(0))
    return F.get(F.filter(F.transform(found, parse_number), lambda v: v.isNotNull()), F.lit(0))


def number_tokens(text: Column, western: bool = False) -> Column:
    """All number tokens as whole numbers, in order."""
    found = F.regexp_extract_all(text if western else western_digits(text), F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, "[^0-9]", "").try_cast("bigint")), lambda v: v > 0)


def slash_pair(text: Column, western: bool = False) -> tuple[Column, Column]:
    """The two numbers of the first a/b; a backslash, a bar or a dash do as well."""
    pattern = rf"({NUMBER})\s*[/\\|-]\s*({NUMBER})"
    bare = text if western else western_digits(text)
    return tuple(F.regexp_replace(F.regexp_extract(bare, pattern, k), "[^0-9]", "").try_cast("bigint") for k in (1, 2))


def near_keyword(text: Column, words: tuple[str, ...], western: bool = False) -> Column:
    """The number within 28 characters without a digit after a word, or before it; the first word that has one. western: the
    text is in lower case with western digits already. The pattern of a word runs only where the word is."""
    bare = text if western else F.lower(western_digits(text))
    picks = []
    for w in words:
        q = rf"\Q{w}\E"
        match = F.regexp_extract(bare, rf"{q}[^0-9]{{0,28}}{NUMBER}|{NUMBER}[^0-9]{{0,28}}{q}", 0)
        picks.append(F.when(bare.contains(w), F.regexp_replace(F.regexp_extract(match, NUMBER, 0), "[^0-9]", "").try_cast("bigint")))
    return F.coalesce(*picks)


def unit_of_text(text: Column, default: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("toman") | low.contains("tmn") | text.contains("تومان"), "toman").when(low.contains("rial") | low.contains("irr") | text.contains("ریال"), "rial").otherwise(default)


def unit_of_numbers(text: Column, numbers: Column) -> Column:
    """By keyword, else by the upper median: from 900,000 rial, 50,000 to 350,000 toman."""
    sorted_ = F.array_sort(numbers)
    middle = F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int"))
    return unit_of_text(text, F.when(middle >= 900_000, "rial").when(middle.between(50_000, 350_000), "toman").otherwise("unknown"))


def to_rial(v: Column, unit: Column) -> Column:
    return F.when(F.lower(F.trim(unit)) == "toman", v * 10).otherwise(v)


def bounded(v: Column, low: float, high: float) -> Column:
    return F.when(v.between(low, high), v)


def implied_fx(coin: Column, usd_per_ounce: Column, ounces: float = 0.235) -> Column:
    """Rial per dollar that the price of a gold coin implies."""
    x = F.try_divide(coin, usd_per_ounce * ounces)
    return F.when((usd_per_ounce > 0) & (x > 0), x)
