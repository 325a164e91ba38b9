"""Summaries of localities from board records and from enriched records, and the gate of publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions import labels, stats
from ratemill.operators import robust


def board(records: DataFrame, benchmark: float) -> DataFrame:
    """A row per locality of records (locality, handle, rate, weight, parse, fresh)."""
    rank = F.when(F.col("fresh") == "fresh", 3).when(F.col("fresh") == "recent", 2).when(F.col("fresh") == "stale", 1).otherwise(0)
    v = F.col("rate")
    a = records.groupBy("locality").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("handle").alias("sources"), F.count_distinct(F.when(F.col("fresh") == "fresh", F.col("handle"))).alias("fresh_sources"), stats.median(v).alias("median_rate"),
        F.coalesce(stats.weighted_mean_any(v, F.col("weight")), stats.median(v)).alias("weighted_rate"), F.max_by("fresh", rank).alias("freshness"), stats.cv_of_mean(v).alias("cv"), F.avg("parse").alias("parse"),
    ).withColumn("dispersion_level", labels.dispersion_board(F.col("cv"), F.col("n")))
    points = (
        F.least(F.lit(28.0), F.col("n") * 4.0) + F.least(F.lit(18.0), F.col("sources") * 6.0) + F.least(F.lit(20.0), F.col("parse") / 4)
        + F.when(F.col("freshness") == "fresh", 16.0).when(F.col("freshness") == "recent", 10.0).when(F.col("freshness") == "stale", 3.0).otherwise(0.0)
        + F.when(F.col("dispersion_level") == "low", 12.0).when(F.col("dispersion_level") == "medium", 6.0).otherwise(0.0)
    )
    b = a.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)), 2))
    state = F.when(F.col("freshness").isin("fresh", "recent") & (F.col("n") >= 4) & (F.col("sources") >= 2) & (F.col("confidence") >= 58), "publish").when((F.col("n") >= 2) & (F.col("confidence") >= 36), "monitor").otherwise("hide")
    reason = F.when(state == "publish", "").when(state == "hide", "insufficient_signal").when(F.col("freshness").isin("stale", "old"), "needs_more_fresh_sources").otherwise("limited_coverage")
    return b.select("locality", "n", "sources", "fresh_sources", "median_rate", "weighted_rate", ((F.col("weighted_rate") - benchmark) / benchmark * 100).alias("spread_pct"), "freshness", "dispersion_level", "confidence", state.alias("state"), reason.alias("reason"))


def enriched(records: DataFrame, benchmark: float) -> DataFrame:
    """As a basket, but outlier removal must not lose the variety of sources: of records (basket, handle, rate, weight, quality, freshness).

    If fewer than two of several sources remain, nothing is removed; if fewer than three of at least three, each missing source, in order of
    its name until there are three, gives back its record nearest to the centre.
    """
    w = Window.partitionBy("basket")
    marked = robust.outliers_basket(records, ["basket"], "rate")
    had = F.size(F.collect_set("handle").over(w))
    left = F.size(F.collect_set(F.when(~F.col("outlier"), F.col("handle"))).over(w))
    counted = marked.withColumn("had", had).withColumn("left", left)
    whole = (F.col("had") >= 2) & (F.col("left") < 2)
    short = ~whole & (F.col("had") >= 3) & (F.col("left") < 3) & (F.col("left") > 0)
    centre = F.median(F.when(~F.col("outlier"), F.col("rate"))).over(w)
    here = Window.partitionBy("basket", "handle")
    lost = F.min(F.col("outlier").cast("int")).over(here) == 1
    near = F.row_number().over(here.orderBy(F.abs(F.col("rate") - F.col("centre")), F.col("quality").desc(), F.col("freshness").desc(), F.col("rate")))
    judged = counted.withColumn("centre", centre).withColumn("lost", lost).withColumn("near", near)
    turn = F.dense_rank().over(Window.partitionBy("basket", "lost").orderBy("handle"))
    kept = judged.withColumn("turn", turn).where(~F.col("outlier") | whole | (short & F.col("lost") & (F.col("near") == 1) & (F.col("turn") <= 3 - F.col("left"))))
    per = kept.groupBy("basket", "handle").agg(F.sum("weight").alias("hw"), F.max("freshness").alias("hf"))
    heads = per.groupBy("basket").agg(F.count(F.lit(1)).alias("sources"), F.try_divide(F.max("hw"), F.sum("hw")).alias("top_share"), F.median("hf").alias("mf"), F.count_if(F.col("hf") >= 85).alias("fresh_sources"))
    v = F.col("rate")
    a = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), stats.median(v).alias("median_rate"), F.coalesce(stats.weighted_mean(v, F.col("weight")), stats.median(v)).alias("weighted_rate"), stats.cv_of_mean(v).alias("cv"), F.avg("freshness").alias("af"), F.avg("quality").alias("aq")).join(heads, "basket")
    signal = F.greatest("af", "mf")
    points = F.least(F.lit(32.0), F.col("n") * 3.5) + F.least(F.lit(18.0), F.col("sources") * 6.0) + F.greatest(F.lit(0.0), 20.0 - F.col("cv") * 90.0) + F.least(F.lit(15.0), F.col("signal") / 6.5) + F.least(F.lit(15.0), F.col("aq") / 7.0)
    spread = (F.col("weighted_rate") - benchmark) / benchmark * 100
    reason = (
        F.when(F.col("n") < 3, "insufficient_usable_records").when(F.col("confidence") < 42, "low_confidence").when(F.col("signal") < 35, "stale_signal").when(F.col("cv") > 0.28, "high_dispersion")
        .when((F.col("top_share") > 0.96) & (F.col("n") < 4), "single_source_dominance").when((F.abs(spread) > 35) & (F.col("sources") < 4), "extreme_divergence").otherwise("")
    )
    done = a.withColumn("signal", signal).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points)), 2)).withColumn("reason", reason)
    return done.select("basket", "n", "sources", "fresh_sources", "median_rate", "weighted_rate", "cv", "top_share", "confidence", spread.alias("spread_pct"), (F.col("reason") == "").alias("publishable"), "reason")
