"""Keyed durable state: the source registry, discovery merges, cards of localities and their history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions import labels
from ratemill.operators import dedup

COUNTS = ("quote_message_count", "usable_record_count")
SETS = ("origins", "localities", "families")
FIELDS = ("title", "status")


def _known(c: Column) -> Column:
    """c, or NULL where it says nothing."""
    return F.when((c != "") & (c != "unknown"), c)


def _union(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def upsert(registry: DataFrame, updates: DataFrame, observed: Column) -> DataFrame:
    """One update per key merged into the registry: texts that say something replace, places only fill in, sets grow, counts keep last and best."""
    r, u = registry.alias("r"), updates.alias("u")
    new = F.col("u.key").isNotNull()
    cols = [F.coalesce("r.key", "u.key").alias("key")]
    cols += [F.coalesce(F.nullif(F.col(f"u.{c}"), F.lit("")), F.col(f"r.{c}")).alias(c) for c in FIELDS]
    cols += [F.coalesce(_known(F.col("r.country")), _known(F.col("u.country")), F.lit("unknown")).alias("country")]
    cols += [_union(F.col(f"r.{c}"), F.col(f"u.{c}")).alias(c) for c in SETS]
    for c in COUNTS:
        cols += [F.coalesce(F.col(f"u.{c}"), F.col(f"r.last_{c}")).alias(f"last_{c}"), F.greatest(F.col(f"r.best_{c}"), F.col(f"u.{c}")).alias(f"best_{c}")]
    worked = F.coalesce(reduce(lambda a, b: a | b, [F.col(f"u.{c}") > 0 for c in COUNTS]), F.lit(False))
    cols += [F.coalesce("r.first_seen", F.when(new, observed)).alias("first_seen"), F.when(new, observed).otherwise(F.col("r.last_seen")).alias("last_seen"), F.when(new & worked, observed).otherwise(F.col("r.last_success")).alias("last_success")]
    return r.join(u, F.col("r.key") == F.col("u.key"), "full_outer").select(*cols)


def merge_found(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Discovered rows of one key become one: the longest name, the first value that says something, any flag, the largest number, all origins."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(ordinal)))
    return records.groupBy(key).agg(
        F.max_by("name", F.struct(F.length("name"), -F.col(ordinal))).alias("name"), first("website").alias("website"), F.bool_or("has_rate").alias("has_rate"), F.max("posts").alias("posts"), F.max("points").alias("points"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"),
    )


def new_only(found: DataFrame, known: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows none of whose keys is known, and of those that share any key with a better row that stays, none but that row.

    Greedy in the given order: a row that is turned away doesn't block later ones. Each round keeps all rows that no open row
    with a shared key precedes and turns away those that share a key with a kept one; the rest go on.
    """
    open_ = found
    for k in keys:
        open_ = open_.join(known.select(F.col(k).alias(f"_{k}")).where(f"_{k} IS NOT NULL").distinct(), F.col(k) == F.col(f"_{k}"), "left_anti")
    open_ = open_.withColumn("_rank", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    kept: DataFrame | None = None
    while True:
        lead = F.lit(True)
        for k in keys:
            w = Window.partitionBy(k)
            lead = lead & (F.col(k).isNull() | (F.col("_rank") == F.min("_rank").over(w)))
        judged = open_.withColumn("_lead", lead).checkpoint()
        winners = judged.where("_lead").drop("_lead")
        kept = winners if kept is None else kept.unionByName(winners)
        rest = judged.where("NOT _lead").drop("_lead")
        for k in keys:
            rest = rest.join(winners.select(F.col(k).alias(f"_{k}")).where(f"_{k} IS NOT NULL").distinct(), F.col(k) == F.col(f"_{k}"), "left_anti")
        open_ = rest.checkpoint()
        if open_.isEmpty():
            return kept.drop("_rank")


STATES = dict(hide=1, monitor=2, publish=3)
ARTIFACTS = {"enriched": 3, "board": 2, "legacy": 1}


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in ranks.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def cards(candidates: DataFrame, most_ratio: float = 1.25, first_by: str | None = None) -> DataFrame:
    """One card per locality: publishable candidates whose rates agree are merged by weight, else the best candidate stands.
    first_by: the number by which the first of equally good ones is told; without it, it is the one of the highest rate."""
    good = (F.col("state") == "publish") & F.col("rate").isNotNull()
    weight = F.greatest(F.least("usable", F.lit(250)), F.col("sources") * 8, F.lit(1)) * F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(50.0)) / 100))
    order = F.struct(_rank(F.col("state"), STATES).alias("a"), F.col("rate").isNotNull().cast("int").alias("b"), F.col("fresh").alias("c"), F.col("sources").alias("d"), F.col("usable").alias("e"), _rank(F.col("artifact"), ARTIFACTS).alias("f"), F.coalesce("confidence", F.lit(0.0)).alias("g"), (-F.col(first_by) if first_by else F.col("rate")).alias("h"))
    w = candidates.withColumn("_w", F.when(good, weight))
    per = w.groupBy("locality").agg(
        F.count_if(good).alias("n_good"), F.max(F.when(good, F.col("rate"))).alias("hi"), F.min(F.when(good, F.col("rate"))).alias("lo"), F.try_divide(F.sum(F.when(good, F.col("rate") * F.col("_w"))), F.sum("_w")).alias("merged_rate"),
        F.try_divide(F.sum(F.when(good, F.col("confidence") * F.col("_w"))), F.sum(F.when(good & F.col("confidence").isNotNull(), F.col("_w")))).alias("merged_confidence"), F.sum(F.when(good, F.col("usable"))).alias("merged_usable"),
        F.max_by(F.struct("state", "artifact", "rate", "confidence", "usable"), order).alias("best"),
    )
    merged = (F.col("n_good") >= 2) & (F.try_divide("hi", "lo") <= most_ratio) & (F.col("lo") > 0)
    merged = F.coalesce(merged, F.lit(False))
    return per.select(
        "locality", F.when(merged, "publish").otherwise(F.col("best.state")).alias("state"), F.when(merged, "merged_diagnostics").otherwise(F.col("best.artifact")).alias("artifact"),
        F.when(merged, F.col("merged_rate")).otherwise(F.col("best.rate")).alias("rate"), F.when(merged, F.col("merged_confidence")).otherwise(F.col("best.confidence")).alias("confidence"), F.when(merged, F.col("merged_usable")).otherwise(F.col("best.usable")).alias("usable"),
    )


def history(old: DataFrame, new: DataFrame, days: int) -> DataFrame:
    """Rows of (ts, locality): new ones replace old ones, those too old go."""
    return dedup.prune_days(dedup.upsert(old, new, ["ts", "locality"]), "ts", days)


def timeseries(rows: DataFrame) -> DataFrame:
    """Per locality the points, how many they are, and the last of each day."""
    marked = rows.withColumn("last", F.row_number().over(Window.partitionBy("locality", F.to_date("ts")).orderBy(F.col("ts").desc())) == 1)
    return marked.groupBy("locality").agg(
        F.count(F.lit(1)).alias("point_count"), F.count_if("last").alias("daily_count"), F.max_by("rate", "ts").alias("latest_rate"), F.array_sort(F.collect_list(F.when(F.col("last"), F.struct("ts", "rate")))).alias("daily")
    )


def alignment(card_rows: DataFrame, benchmark: float) -> DataFrame:
    spread = (F.col("rate") - benchmark) / benchmark * 100
    return card_rows.withColumn("spread_pct", spread).withColumn("alignment", labels.alignment(spread))
