"""Ladders that turn a number into a label. Ladders of one name differ on purpose: each belongs to another report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(v: Column, steps: list[tuple[float, object]], other: object, none: object = None, strict: bool = False) -> Column:
    """The value of the first step that v is not above (below, if strict)."""
    c = F.when(v.isNull(), F.lit(none))
    for limit, value in steps:
        c = c.when((v < limit) if strict else (v <= limit), F.lit(value))
    return c.otherwise(F.lit(other))


def freshness_points(hours: Column) -> Column:
    return ladder(hours, [(6, 100), (24, 88), (48, 76), (72, 66), (168, 45)], 25, 35)


def freshness_by_hours(hours: Column) -> Column:
    return ladder(hours, [(30, "fresh"), (96, "recent"), (720, "stale")], "old", "unknown")


def freshness_by_points(points: Column) -> Column:
    return F.when(points >= 85, "fresh").when(points >= 60, "recent").when(points >= 40, "stale").otherwise("old")


def freshness_by_days(days: Column) -> Column:
    return ladder(days, [(14, "fresh"), (60, "recent")], "stale", "unknown")


def dispersion_model(cv: Column) -> Column:
    return ladder(cv, [(0.015, "low"), (0.03, "moderate")], "high", "unknown")


def dispersion_board(cv: Column, n: Column) -> Column:
    return F.when(n <= 1, "low").otherwise(ladder(cv, [(0.03, "low"), (0.08, "medium")], "high", "high"))


def dispersion_card(cv: Column) -> Column:
    return ladder(cv, [(0.08, "low"), (0.18, "medium")], "high", "unknown", strict=True)


def dispersion_research(cv: Column) -> Column:
    return ladder(cv, [(0.02, "low"), (0.05, "medium")], "high", "unknown")


def fix_status(dispersion: Column, withheld: Column) -> Column:
    """Green, Amber or Red by dispersion, WITHHOLD where withheld or above."""
    return F.when(withheld | dispersion.isNull(), "WITHHOLD").when(dispersion <= 0.015, "Green").when(dispersion <= 0.035, "Amber").when(dispersion <= 0.05, "Red").otherwise("WITHHOLD")


def alignment(spread_pct: Column) -> Column:
    a = F.abs(spread_pct)
    return F.when(a.isNull(), "Unavailable").when(a < 2, "Aligned").when(a <= 10, "Mild divergence").otherwise("Divergent")


def status_text(rate: Column, confidence: Column, n: Column, level: Column) -> Column:
    return (
        F.when(rate.isNull(), "Benchmark unavailable")
        .when((n >= 3) & (confidence >= 80) & (level == "low"), "High-confidence benchmark")
        .when((n >= 2) & (confidence >= 50) & level.isin("low", "moderate"), "Benchmark active with moderate confidence")
        .when(n >= 2, "Benchmark active but elevated dispersion")
        .otherwise("Benchmark active but thinly sourced")
    )


def warning_text(n: Column, outliers: Column, level: Column, diagnostic_only: Column) -> Column:
    """The first warning that applies; outliers and diagnostic_only are arrays of names."""
    return (
        F.when(n < 2, "Benchmark is running on fewer than two eligible sources.")
        .when(F.size(outliers) > 0, F.concat(F.lit("Outlier screening removed: "), F.array_join(outliers, ", "), F.lit(".")))
        .when(level == "high", "Eligible sources remain materially dispersed.")
        .when(F.size(diagnostic_only) > 0, F.concat(F.lit("Diagnostics-only sources excluded from benchmark: "), F.array_join(diagnostic_only, ", "), F.lit(".")))
    )


def spread_check(buy: Column, sell: Column, most: float) -> Column:
    """ok, reason and spread of a buy and a sell quote."""
    spread = F.try_divide(sell - buy, sell)
    reason = (
        F.when(buy.isNull() | sell.isNull(), "missing USD buy/sell quote")
        .when(buy > sell, "buy quote above sell quote")
        .when(sell <= 0, "invalid sell quote")
        .when(spread <= 0, "non-positive bid/ask spread")
        .when(spread > most, "bid/ask spread exceeds configured maximum")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(buy <= sell, F.when(sell > 0, spread)).alias("spread_pct"))


def channel_status(extracted: Column, kept: Column, direct: Column, quality: Column, readiness: Column, pairs: Column) -> Column:
    repeat = 1.0 - kept / F.greatest(F.lit(1), extracted)
    return (
        F.when(extracted <= 1, "low_value")
        .when((repeat >= 0.60) & (extracted >= 5), "duplicate_heavy")
        .when((quality < 40) & (extracted >= 3), "unstable_format")
        .when((readiness >= 72) & (kept >= 6) & (quality >= 58), "ready_for_research_ingestion")
        .when((readiness >= 45) & (kept >= 3), "monitor_only")
        .when((pairs == 0) & (direct == 0), "unstable_format")
        .otherwise("low_value")
    )
