"""The daily fix: from samples of many sources to a value, a band, a status and indicators.

samples: day, source, benchmark, value, sampled_at, quote_time, ok, stale. All functions group by day, so any number of
days is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions import labels, numbers, stats, times

PRIMARY = "open_market"
COMPANIONS = ("regional_transfer", "crypto_usdt", "emami_gold_coin")
BENCHMARKS = (PRIMARY, "official", *COMPANIONS)
MOST_DISPERSION = 0.05
DAY_MICROS = 86_400_000_000


def refreshed(samples: DataFrame) -> Column:
    """What a refresh of the current day may take of the primary benchmark beside valid samples: values that were fetched, whose
    validation didn't fail, and that are at most stale or outside the window. Samples that lack fetched, validated or error tell
    nothing of it and pass; a NULL error is none, a NULL validation hasn't failed, a NULL fetch has."""
    told = lambda name, test: test(F.col(name)) if name in samples.columns else F.lit(True)
    mild = lambda e: F.coalesce(F.lower(F.trim(e)), F.lit("")).isin("", "stale quote", "sample outside observation window")
    return told("fetched", lambda c: F.coalesce(c, F.lit(False))) & told("validated", lambda c: F.coalesce(c, F.lit(True))) & told("error", mild)


def source_medians(samples: DataFrame, allow_stale: bool = False) -> DataFrame:
    """day, benchmark, source, m: the median of a source's usable samples; any_stale of all its samples. With allow_stale
    stale ones count where refreshed() says so."""
    usable = F.when(F.col("benchmark") == PRIMARY, F.col("ok") & ~F.col("stale") if not allow_stale else refreshed(samples)).otherwise(True)
    per = samples.groupBy("day", "benchmark", "source").agg(stats.median(F.when(usable & (F.col("value") > 0), F.col("value"))).alias("m"), F.bool_or("stale").alias("any_stale"))
    return per.where("m IS NOT NULL")


def bands(medians: DataFrame, keys: list[str], allow_stale: bool = False) -> DataFrame:
    """fix, p25, p75, dispersion, status, withheld and available of each group of source medians."""
    spoiled = F.bool_or(F.col("benchmark").isin(*COMPANIONS) & F.col("any_stale")) if not allow_stale else F.lit(False)
    raw = medians.groupBy(*keys).agg(F.count("m").alias("n_sources"), F.percentile("m", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), spoiled.alias("spoiled"))
    d = F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])
    held = (F.coalesce(d, F.lit(0.0)) > MOST_DISPERSION) | F.col("spoiled")
    return raw.select(
        *keys, "n_sources", F.col("q")[1].alias("fix"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), d.alias("dispersion"),
        labels.fix_status(d, held).alias("status"), held.alias("withheld"), (~held).alias("available"),
    )


def fixes(samples: DataFrame, allow_stale: bool = False) -> DataFrame:
    """The fix of every day and benchmark but the official one, which official() picks."""
    return bands(source_medians(samples.where("benchmark <> 'official'"), allow_stale), ["day", "benchmark"], allow_stale)


def latest(samples: DataFrame, only_fresh: Column | None = None) -> DataFrame:
    """day, benchmark, source, value, effective_time: each source's latest value, by quote time where it has one."""
    effective = F.coalesce("quote_time", "sampled_at")
    some = samples.where("value > 0") if only_fresh is None else samples.where("value > 0").where(only_fresh)
    best = F.max_by(F.struct("value", effective.alias("effective_time"), "sampled_at"), F.struct(effective, "sampled_at", "value"))
    return some.groupBy("day", "benchmark", "source").agg(best.alias("b"), cadence().alias("cadence")).select("day", "benchmark", "source", "b.*", "cadence")


def cadence() -> Column:
    """Distinct quote times, or 1 if there are values without any."""
    return F.greatest(F.count_distinct("quote_time"), F.max(F.when(F.col("value") > 0, 1).otherwise(0)).cast("long"))


def official(samples: DataFrame, fresh_hours: int = 48, stale_hours: int = 45 * 24) -> DataFrame:
    """Per day the value of the sources with the freshest quote, among those the ones that update most; a source without a fresh quote
    falls back to a stale one within the horizon."""
    ours = samples.where("benchmark = 'official'")
    fresh = latest(ours, times.fresh(F.col("quote_time"), F.col("sampled_at"), fresh_hours)).withColumn("is_stale", F.lit(False))
    any_ = latest(ours).where(times.fresh(F.col("effective_time"), F.col("sampled_at"), stale_hours)).withColumn("is_stale", F.lit(True))
    both = fresh.unionByName(any_)
    one = F.row_number().over(Window.partitionBy("day", "benchmark", "source").orderBy("is_stale"))
    per = both.withColumn("k", one).where("k = 1").drop("k")
    day = Window.partitionBy("day")
    first = per.withColumn("top", F.max("effective_time").over(day)).where("effective_time = top")
    ranked = first.withColumn("most", F.max("cadence").over(day)).withColumn("n_freshest", F.count(F.lit(1)).over(day)).where("cadence = most")
    picked = ranked.groupBy("day", "n_freshest").agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.array_sort(F.collect_set("source")).alias("selected_sources"), F.max("effective_time").alias("selected_quote_time"), F.count(F.lit(1)).alias("n"), F.bool_or("is_stale").alias("using_stale_fallback")
    )
    d = F.try_divide(F.col("q")[2] - F.col("q")[0], F.col("q")[1])
    held = d > MOST_DISPERSION
    return picked.select(
        "day", F.col("q")[1].alias("fix"), d.alias("dispersion"), labels.fix_status(d, held).alias("status"), "selected_sources", "selected_quote_time",
        F.when(F.col("n") < F.col("n_freshest"), "freshest_quote_time_then_update_cadence").otherwise("freshest_quote_time").alias("selection_method"), "using_stale_fallback",
    )


def gaps(wide: DataFrame, gold_usd_per_oz: float = 3000.0) -> DataFrame:
    """The four gaps in percent of a row per day with a column of each benchmark's fix, NULL where withheld."""
    s, o, t, c = (F.col(b) for b in (PRIMARY, "official", "regional_transfer", "crypto_usdt"))
    gold = numbers.implied_fx(F.col("emami_gold_coin"), F.lit(gold_usd_per_oz))
    pct = lambda a, b: F.try_divide(a - b, b) * 100
    return wide.select("day", pct(s, o).alias("street_official_gap_pct"), pct(s, t).alias("street_transfer_gap_pct"), pct(c, s).alias("street_crypto_gap_pct"), pct(gold, s).alias("street_gold_gap_pct"))


def widen(fixed: DataFrame) -> DataFrame:
    """One row per day with the available fix of each benchmark."""
    return fixed.groupBy("day").agg(*[F.max(F.when((F.col("benchmark") == b) & F.col("available"), F.col("fix"))).alias(b) for b in BENCHMARKS])


def sanity_warnings(street: Column, official_: Column) -> Column:
    ratio = F.try_divide(official_, street)
    return F.array_compact(F.array(F.when(official_ > street * 1.05, "official_above_street"), F.when((ratio < 0.3) | (ratio > 1.3), "official_outside_band")))


def peer_validation(samples: DataFrame, subject: str, peers: list[str], most: float = 0.20) -> DataFrame:
    """Checks each sample of subject against the median of the peers' samples of the same attempt: adds peer_median, deviation and result."""
    mine = samples.where(F.col("source") == subject)
    others = samples.where(F.col("source").isin(peers) & F.col("ok") & ~F.col("stale") & (F.col("value") > 0)).groupBy("attempt").agg(stats.median(F.col("value")).alias("peer_median"))
    dev = F.try_divide(F.abs(F.col("value") - F.col("peer_median")), F.col("peer_median"))
    result = F.when(~F.col("ok") | F.col("stale") | F.col("value").isNull(), "skipped_sample_not_valid").when(F.col("peer_median").isNull(), "skipped_no_peer_values").when(F.col("peer_median") <= 0, "skipped_invalid_peer_median").when(dev > most, "failed").otherwise("passed")
    return mine.join(others, "attempt", "left").withColumn("peer_deviation", F.when(result.isin("failed", "passed"), dev)).withColumn("peer_result", result)


def is_public(status: Column, withheld: Column, fix: Column) -> Column:
    """A published row: a coloured status, not withheld (a NULL is not false), a finite positive fix."""
    return F.coalesce(status.isin("Green", "Amber", "Red") & withheld.eqNullSafe(F.lit(False)) & (fix > 0) & ~F.isnan(fix) & (fix < float("inf")), F.lit(False))
