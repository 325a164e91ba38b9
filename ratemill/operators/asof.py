"""Lookups of the latest earlier row, as windows over ordered keys: no inequality join, so each key is sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_days_before(df: DataFrame, keys: list[str], day: str, value: str, days: int, name: str) -> DataFrame:
    """Adds the value of the latest row of the key that is at least so many days earlier."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -days)
    return df.withColumn(name, F.max_by(value, day).over(w))


def trend(df: DataFrame, keys: list[str], day: str, value: str, days: int = 7) -> DataFrame:
    """Percent change against the latest row at least so many days earlier; NULL without one or if it isn't positive."""
    base = F.col("base")
    return value_days_before(df, keys, day, value, days, "base").withColumn("trend_pct", F.when((base > 0) & (F.col(value) > 0), (F.col(value) - base) / base * 100)).drop("base")


def backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], usable: Column | None = None, horizon_days: int | None = None) -> DataFrame:
    """Each left row with values of the latest right row of its key that is strictly earlier (by at), usable and not older than the horizon.

    Both sides are laid in one ordered sequence per key; a running last value carries right rows forward.
    """
    some = right if usable is None else right.where(usable)
    marked = some.select(*keys, at, F.struct(at, *values).alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    ours = left.select(*keys, at, F.lit(None).cast(marked.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    # at equal times the left row comes first, so that only earlier right rows are behind it
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_left").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = ours.unionByName(marked).withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    hit = F.col("_seen")
    if horizon_days is not None:
        hit = F.when(F.datediff(F.col("_left")[at], F.col("_seen")[at]) <= horizon_days, F.col("_seen"))
    return seen.select("_left.*", hit.alias("_hit")).select("*", F.col("_hit")[at].alias(f"matched_{at}"), *[F.col("_hit")[v].alias(f"matched_{v}") for v in values]).drop("_hit")
