"""Outlier rules, concentration and weights over groups. The rules are variants that differ on purpose."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions import rules, stats


def joined(df: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """df with the further columns of per, a row per group; NULL is a key like any other."""
    x, y = df.alias("_x"), per.alias("_y")
    on = functools.reduce(Column.__and__, [F.col(f"_x.{k}").eqNullSafe(F.col(f"_y.{k}")) for k in keys])
    return x.join(y, on, "left").select("_x.*", *[F.col(f"_y.{c}") for c in per.columns if c not in keys])


def _centred(df: DataFrame, keys: list[str], v: str, *more: Column) -> DataFrame:
    """Adds n, med and mad of the group, and more aggregates of it. Percentiles are partial aggregates here, not windows, so no task sees a whole group's rows."""
    m = joined(df, df.groupBy(*keys).agg(F.count(v).alias("n"), F.median(v).alias("med"), *more), keys)
    return joined(m, m.groupBy(*keys).agg(F.median(F.abs(F.col(v) - F.col("med"))).alias("mad")), keys)


def trimmed_mean(df: DataFrame, keys: list[str], v: str, rule: str = "model", share: float = 0.10) -> DataFrame:
    """keys and trimmed: as stats.trimmed_model, trimmed_basket or trimmed_research, of groups of any size. Values are counted
    first; what of each value lies between the ends follows from running counts."""
    some = F.col(v) > 0 if rule == "basket" else F.col(v).isNotNull()
    counts = df.where(some).groupBy(*keys, F.col(v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_to", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    n, cut = F.col("_n"), F.floor(F.col("_n") * share)
    if rule == "model":
        cut = F.when((n <= 2) | (cut * 2 >= n), 0).otherwise(cut)
    elif rule == "basket":
        cut = F.when(n < 4, 0).otherwise(F.least(cut, F.greatest(F.lit(0), F.floor((n - 2) / 2))))
    else:
        cut = F.when(n <= 2, 0).otherwise(F.least(cut, F.floor((n - 1) / 2)))
    kept = F.greatest(F.lit(0), F.least(F.col("_to"), n - cut) - F.greatest(F.col("_to") - F.col("_c"), cut))
    return run.withColumn("_kept", kept).groupBy(*keys).agg(F.try_divide(F.sum(F.col("_v") * F.col("_kept")), F.sum("_kept")).alias("trimmed"))


def outliers_model(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Adds modified_z and outlier: |0.6745 (v - med) / mad| > 3.5 in groups of three and more with a mad."""
    c = _centred(df, keys, v)
    z = F.when((F.col("n") >= 3) & (F.col("mad") != 0), F.lit(0.6745) * (F.col(v) - F.col("med")) / F.nullif("mad", F.lit(0.0)))
    return c.withColumn("modified_z", z).withColumn("outlier", F.coalesce(F.abs("modified_z") > 3.5, F.lit(False)))


def outliers_basket(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Adds outlier: farther than 4 mad and than 2.5 % of the median, in groups of five and more with a mad."""
    c = _centred(df, keys, v)
    far = F.abs(F.col(v) - F.col("med"))
    rel = F.when(F.col("med") > 0, far / F.nullif("med", F.lit(0.0))).otherwise(0.0)
    return c.withColumn("outlier", F.coalesce((F.col("n") >= 5) & (F.col("mad") > 0) & (far / F.nullif("mad", F.lit(0.0)) > 4.0) & (rel > 0.025), F.lit(False)))


def outliers_research(df: DataFrame, keys: list[str], v: str, least: int = 5) -> DataFrame:
    """Adds outlier: robust z above 3.5, or outside the 5th to 95th percentile, in groups of at least so many."""
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.95)))
    c = _centred(df, keys, v, q[0].alias("p05"), q[1].alias("p95"))
    z = F.when(F.col("mad") > 0, F.lit(0.6745) * F.abs(F.col(v) - F.col("med")) / F.nullif("mad", F.lit(0.0))).otherwise(0.0)
    return c.withColumn("outlier", F.coalesce((F.col("n") >= least) & ((z > 3.5) | (F.col(v) < F.col("p05")) | (F.col(v) > F.col("p95"))), F.lit(False)))


def dispersion(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """count, min, max, median, p25, p75, range and cv (of the mean) of each group."""
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"), stats.cv_of_mean(F.col(v)).alias("cv")).select(*keys, "n", "min", "max", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), (F.col("max") - F.col("min")).alias("range"), "cv")


def dispersion_full(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """As dispersion(), with iqr, mad, population deviation and the cv of the median."""
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    per = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), q.alias("q"), F.stddev_pop(v).alias("std"))
    far = joined(df.select(*keys, v), per.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(v) - F.col("median"))).alias("mad"))
    return joined(per, far, keys).select(*keys, "n", "min", "max", "median", "mad", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "std", F.try_divide("std", "median").alias("cv_median"))


def concentration(df: DataFrame, keys: list[str], who: str, weight: Column) -> DataFrame:
    """top_share, top3_share, hhi and effective_n of the members' shares of each group's weight."""
    per = df.groupBy(*keys, who).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    ranked = per.withColumn("share", F.try_divide("w", F.sum("w").over(w))).withColumn("k", F.row_number().over(w.orderBy(F.col("w").desc(), who)))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_members"), F.max("share").alias("top_share"), F.sum(F.when(F.col("k") <= 3, F.col("share"))).alias("top3_share"), F.sum(F.col("share") * F.col("share")).alias("hhi")
    ).withColumn("effective_n", F.try_divide(F.lit(1.0), "hhi"))


def basket_weight(base: Column, quality: Column, freshness: Column, directness: Column, readiness: Column) -> Column:
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return base * clamp(quality / 100, 0.45, 1.15) * clamp(freshness / 100, 0.35, 1.10) * clamp(0.55 + directness / 200, 0.55, 1.10) * clamp(0.60 + readiness / 200, 0.60, 1.10)


def pseudo_weight(parse: Column, freshness: Column, kind: Column, density: Column) -> Column:
    """A record's weight where all that is known is how well its source parses, how fresh it is, and of what kind."""
    board = kind.isin("regional_fx_board", "regional_market_channel")
    base = F.when(board, 0.82).when(kind == "exchange_shop", 1.0).when(kind == "aggregator", 0.55).otherwise(0.5)
    fresh = F.when(freshness == "fresh", 90.0).when(freshness == "recent", 70.0).when(freshness == "stale", 45.0).otherwise(28.0)
    by_kind = F.when(kind == "regional_fx_board", 1.0).when(kind == "regional_market_channel", 0.88).when(kind == "exchange_shop", 0.72).when(kind == "aggregator", 0.55).otherwise(0.45)
    return basket_weight(base, parse.cast("double"), fresh, F.when(board, 70.0).otherwise(58.0), density.cast("double")) * by_kind


def basket_rows(records: DataFrame, usable: Column) -> DataFrame:
    """A row per basket of all records, with the estimates, spread, concentration and coherence of its usable ones.

    records: basket, handle, rate, weight, freshness, structure.
    """
    ours = records.where(usable)
    v = F.col("rate")
    per = ours.groupBy("basket").agg(F.count(F.lit(1)).alias("usable"), stats.median(v).alias("median"), stats.weighted_mean(v, F.col("weight")).alias("weighted"), stats.cv_of_mean(v).alias("cv"), F.avg("freshness").alias("fresh"), F.avg("structure").alias("struct"))
    heads = concentration(ours, ["basket"], "handle", F.col("weight")).select("basket", "top_share", "effective_n")
    rows = joined(joined(records.groupBy("basket").agg(F.count(F.lit(1)).alias("input")), per, ["basket"]), heads, ["basket"])
    rows = joined(rows, trimmed_mean(ours, ["basket"], "rate", "research"), ["basket"]).withColumn("usable", F.coalesce("usable", F.lit(0)))
    scored = rows.withColumn("coherence", rules.coherence(F.col("usable"), F.col("cv"), F.col("top_share"), F.col("effective_n"), F.coalesce("fresh", F.lit(0.0)), F.coalesce("struct", F.lit(0.0))))
    return scored.withColumn("stability", rules.stability(F.col("coherence"), F.col("usable"), F.col("cv"), F.col("top_share"))).drop("fresh", "struct")


def channel_ranking(usable: DataFrame) -> DataFrame:
    """A row per channel: estimate, averages, its share of its basket's weight, score and role. usable: as basket_rows(), with quality."""
    per = usable.groupBy("handle").agg(
        F.min("basket").alias("basket"), F.count(F.lit(1)).alias("n"), stats.weighted_mean(F.col("rate"), F.col("weight")).alias("weighted"), F.avg("quality").alias("q"), F.avg("freshness").alias("f"), F.avg("structure").alias("s"), F.sum("weight").alias("w")
    )
    whole = usable.groupBy("basket").agg(F.sum("weight").alias("all"))
    shared = joined(per, whole, ["basket"]).withColumn("share", F.coalesce(F.when(F.col("all") > 0, F.col("w") / F.col("all")), F.lit(0.0)))
    score = 0.4 * F.col("q") + 0.2 * F.col("s") + 0.2 * F.col("f") + 0.2 * F.least(F.lit(100.0), F.col("n") * 8.0) - F.when(F.col("share") > 0.35, 12.0).otherwise(0.0)
    return shared.select("handle", "basket", "n", "weighted", "share", F.round(score + 1e-9, 2).alias("score"), rules.ranking_role(F.col("n"), F.col("q"), F.col("s"), F.col("share")).alias("role"))


def model_weight(base: Column, kind: Column, buy: Column, sell: Column) -> Column:
    """Base weight, more for midpoints, less for reported values and wide spreads."""
    mid = (buy + sell) / 2
    spread = F.abs(sell - buy) / F.nullif(mid, F.lit(0.0))
    return base * F.when(kind == "midpoint", 1.08).when(kind == "reported_open_market", 0.98).otherwise(1.0) * F.when(spread.isNull(), 1.0).otherwise(F.greatest(F.lit(0.70), 1.0 - F.least(spread, F.lit(0.08)) * 2.5))


def model_confidence(n: Column, cv: Column, points: Column, change: Column, outliers: Column) -> Column:
    raw = (
        F.least(n / 3.0, F.lit(1.0)) * 40.0
        + F.greatest(F.lit(0.0), 1.0 - F.least(F.coalesce(cv, F.lit(1.0)), F.lit(0.08)) / 0.08) * 35.0
        + F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least(change, F.lit(0.06)) / 0.06) * 25.0 * F.least(points / 7.0, F.lit(1.0)), F.lit(0.0))
        - F.least(outliers * 5.0, F.lit(15.0))
    )
    raw = F.greatest(F.lit(0.0), raw)
    return F.round(F.when(n < 2, F.least(raw, F.lit(55.0))).otherwise(raw), 2)


def history_stability(df: DataFrame, keys: list[str], day: str, v: str) -> DataFrame:
    """points, cv, median and largest absolute change from one point to the next."""
    w = Window.partitionBy(*keys).orderBy(day)
    prior = F.lag(v).over(w)
    changed = df.withColumn("change", F.when(prior != 0, F.abs((F.col(v) - prior) / F.nullif(prior, F.lit(0.0)))))
    return changed.groupBy(*keys).agg(F.count(v).alias("history_points"), stats.cv_of_mean(F.col(v)).alias("history_cv"), F.median("change").alias("median_abs_change"), F.max("change").alias("max_abs_change"))


def summarize_baskets(records: DataFrame, benchmark: float) -> DataFrame:
    """A row per basket: rates, spread against the benchmark, confidence, and whether and why not to publish.

    records: basket, handle, rate, category, weight, freshness.
    """
    marked = outliers_basket(records, ["basket"], "rate")
    clean = marked.where("NOT outlier")
    removed = marked.groupBy("basket").agg(F.count_if("outlier").alias("outliers_removed"))
    per = clean.groupBy("basket", "handle").agg(F.sum("weight").alias("hw"), F.max("freshness").alias("hf"))
    heads = per.groupBy("basket").agg(F.count(F.lit(1)).alias("channels"), F.count_if(F.col("hf") >= 85).alias("fresh_channels"), F.try_divide(F.max("hw"), F.sum("hw")).alias("top_share"))
    v = F.col("rate")
    rates = clean.groupBy("basket").agg(
        F.count(F.lit(1)).alias("usable"), stats.median(v).alias("median_rate"), stats.weighted_mean(v, F.col("weight")).alias("weighted_rate"),
        stats.cv_of_mean(v).alias("cv"), F.avg("freshness").alias("avg_fresh"), F.try_divide(F.sum(F.when(F.col("category") == "direct_shop", F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("direct_share"),
    )
    clamp = lambda x, b: F.greatest(F.lit(0.0), F.least(F.lit(b), x))
    confidence = F.round(F.least(F.lit(30.0), F.col("usable") * 3.0) + F.least(F.lit(25.0), F.col("channels") * 7.0) + F.greatest(F.lit(0.0), 25.0 - F.col("cv") * 120.0) + clamp(F.col("avg_fresh") / 10, 10.0) + clamp(F.col("direct_share") * 10, 10.0), 2)
    reason = (
        F.when(F.col("usable") < 4, "insufficient_usable_records").when(F.col("channels") < 2, "single_channel_concentration").when(F.col("cv") > 0.18, "high_dispersion")
        .when(F.col("top_share") > 0.78, "concentrated_single_source").when(F.col("confidence") < 55, "low_confidence").otherwise("")
    )
    trims = trimmed_mean(clean, ["basket"], "rate", "basket").withColumnRenamed("trimmed", "trimmed_rate")
    whole = rates.join(heads, "basket").join(removed, "basket").join(trims, "basket", "left").withColumn("weighted_rate", F.coalesce("weighted_rate", "median_rate")).withColumn("confidence", confidence).withColumn("suppression_reason", reason)
    return whole.select(
        "basket", "usable", "channels", "fresh_channels", "outliers_removed", "median_rate", "weighted_rate", "trimmed_rate", "cv", "top_share", "confidence",
        F.when(F.lit(benchmark > 0), (F.col("weighted_rate") - benchmark) / benchmark * 100).alias("spread_pct"), (F.col("suppression_reason") == "").alias("publishable"), "suppression_reason",
    )
