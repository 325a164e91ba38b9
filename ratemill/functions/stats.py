"""Robust statistics as grouped aggregates: every function takes columns and gives an aggregate or array expression.

Percentiles are exact with linear interpolation; standard deviations are of the population. The trimmed means here hold a
group's values in one array: for groups of a few sources; robust.trimmed_mean() takes groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = F.isnan


def median(v: Column) -> Column:
    return F.percentile(v, F.lit(0.5))


def percentile(v: Column, p: float) -> Column:
    return F.percentile(v, F.lit(p))


def finite(v: Column) -> Column:
    """v, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def cv_of_mean(v: Column) -> Column:
    """Population deviation over the mean: 0 for one value, NULL for none or a mean of 0."""
    n = F.count(v)
    return F.when(n == 1, F.lit(0.0)).when((n > 1) & (F.avg(v) != 0), F.stddev_pop(v) / F.nullif(F.avg(v), F.lit(0.0)))


def cv_of_median(v: Column) -> Column:
    """Population deviation over the median, as the research tables have it."""
    return F.stddev_pop(v) / F.nullif(median(v), F.lit(0.0))


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def trimmed_model(v: Column, share: float = 0.10) -> Column:
    """Mean without the int(share·n) least and greatest; the plain mean of up to two values, or where all would go."""
    a = F.array_sort(F.collect_list(v))
    n = F.size(a)
    cut = F.floor(n * share).cast("int")
    return _mean(F.when((n <= 2) | (cut <= 0) | (cut * 2 >= n), a).otherwise(F.slice(a, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))))


def trimmed_basket(v: Column, share: float = 0.10) -> Column:
    """Positive values only; the plain mean of up to three; at most (n - 2) / 2 go at each end."""
    a = F.array_sort(F.collect_list(F.when(v > 0, v)))
    n = F.size(a)
    cut = F.least(F.floor(n * share).cast("int"), F.greatest(F.lit(0), F.floor((n - 2) / 2).cast("int")))
    return _mean(F.when((n < 4) | (cut <= 0), a).otherwise(F.slice(a, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))))


def trimmed_research(v: Column, share: float = 0.10) -> Column:
    """At most (n - 1) / 2 go at each end."""
    a = F.array_sort(F.collect_list(v))
    n = F.size(a)
    cut = F.least(F.floor(n * share).cast("int"), F.floor((n - 1) / 2).cast("int"))
    return _mean(F.when((n <= 2) | (cut <= 0), a).otherwise(F.slice(a, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))))


def weighted_mean(v: Column, w: Column) -> Column:
    """Mean by the positive weights; NULL if there are none."""
    real = F.when((w > 0) & v.isNotNull(), w)
    return F.try_divide(F.sum(F.when(real.isNotNull(), v * w)), F.sum(real))


def weighted_mean_any(v: Column, w: Column) -> Column:
    """Mean by all weights; NULL if they don't sum to more than 0."""
    return F.when(F.sum(w) > 0, F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0)))
