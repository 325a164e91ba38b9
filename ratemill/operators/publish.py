"""Choosing a day's attempt, filling in what it lacks, and checking what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions import times


def pick_attempt(attempts: DataFrame) -> DataFrame:
    """Per day the latest valid attempt within the window, else the latest of all; how many there were. attempts: day, at, fix, status, withheld."""
    valid = F.col("status").isin("Green", "Amber", "Red") & F.col("withheld").eqNullSafe(F.lit(False)) & (F.col("fix") > 0)
    good = F.coalesce(valid, F.lit(False)) & times.in_window(F.col("at"))
    return attempts.groupBy("day").agg(
        F.max_by(F.struct("at", "fix", "status", "withheld"), F.struct(good, F.col("at"), F.col("fix"))).alias("b"), F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("valid_candidates")
    ).select("day", "b.*", "attempts", "valid_candidates", F.when(F.col("valid_candidates") > 0, "latest_valid_in_window").otherwise("latest_attempt").alias("strategy"))


def gap_value(stored: Column, street: Column, other: Column, withheld: Column) -> Column:
    """A day's gap: the stored one, else recomputed; NULL for a day that is withheld."""
    return F.when(~F.coalesce(withheld, F.lit(False)), F.coalesce(stored, F.try_divide(street - other, other) * 100))


def placeholders(days: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """A row for every day and key; those that aren't found are withheld."""
    all_ = days.select("day", F.explode(F.array(*[F.lit(k) for k in keys])).alias("benchmark"))
    return all_.join(found, ["day", "benchmark"], "left").select("day", "benchmark", "fix", F.coalesce("status", F.lit("WITHHOLD")).alias("status"), F.coalesce("withheld", F.lit(True)).alias("withheld"))


def guardrails(latest: DataFrame, attempts: DataFrame) -> DataFrame:
    """day and failure of every check that a published day fails. latest: day, fix, withheld, reason, valid_candidates, official_ok; attempts: day, fix, withheld, official_ok."""
    tried = attempts.groupBy("day").agg(F.count(F.lit(1)).alias("tries"), F.bool_or(F.col("fix").isNotNull() & ~F.col("withheld")).alias("any_valid"), F.bool_or("official_ok").alias("any_official"))
    j = latest.join(tried, "day", "left")
    held = F.coalesce("withheld", F.lit(True))
    failed = F.array_compact(F.array(
        F.when((F.col("tries") > 0) & (F.col("reason") == "no intraday samples"), "intraday_samples_exist"), F.when(held & (F.col("valid_candidates") > 0), "withheld_despite_candidates"),
        F.when(held & (F.col("reason") == "no valid sources available") & F.col("any_valid"), "valid_sources_exist"), F.when(~held & F.col("fix").isNull(), "published_without_fix"), F.when(~F.coalesce("official_ok", F.lit(False)) & F.col("any_official"), "official_available"),
    ))
    return j.select("day", F.explode(failed).alias("failure"))
