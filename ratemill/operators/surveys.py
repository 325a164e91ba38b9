"""Summaries of discovery surveys, seeds of the next one, merges of what two of them found, and rows of a model's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.operators.robust import joined

HANDLE = "^[a-z0-9_]{5,}$"
TRADE_CHANNELS = ("aggregator", "dealer_network_channel", "market_price_channel")


def distribution(df: DataFrame, what: str) -> DataFrame:
    """what and n, the most frequent first by rank; of equals the first by name."""
    n = df.groupBy(what).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), what)))


def contributions(records: DataFrame, ordinal: str) -> DataFrame:
    """A row per channel of its records: what the first says of it, how many there are, their averages."""
    first = F.min_by(F.struct("title", "locality", "category"), ordinal)
    per = records.groupBy("handle").agg(first.alias("f"), F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 2).alias("quality"), F.round(F.avg("freshness"), 2).alias("freshness"))
    return per.select("handle", "f.*", "n", "quality", "freshness")


def discovery_summary(channels: DataFrame) -> DataFrame:
    """One row of counts over channels (kind, quotes, shop, parse)."""
    return channels.agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(F.col("quotes") > 0).alias("with_quotes"), F.count_if("shop").alias("shops"), F.count_if(F.col("kind") == "market_price_channel").alias("market_channels"), F.count_if(F.col("parse") >= 60).alias("parseable")
    )


def signal_summary(channels: DataFrame) -> DataFrame:
    """One row over channels (kind, quotes, pairs, shop, priority), with the size of the universe of signals."""
    strong = F.col("priority").isin("P1", "P2") & (F.col("quotes") >= 3)
    one = channels.agg(
        F.count(F.lit(1)).alias("channels"), F.count_if(F.col("quotes") >= 2).alias("with_several"), F.coalesce(F.sum("quotes"), F.lit(0)).alias("quotes"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.count_if(F.col("shop") & strong).alias("strong_shops"), F.count_if(F.col("kind").isin("dealer_network_channel", "market_price_channel") & strong).alias("strong_networks"),
    )
    return one.withColumn("universe", F.when(F.col("quotes") < 80, "few_dozen_signals").when(F.col("quotes") < 250, "around_100_signals").otherwise("several_hundred_signals"))


def multilingual_summary(sources: DataFrame, known: int) -> DataFrame:
    """One row over new sources (kind, quotes, pairs, parse): counts, and the records that they may add."""
    good = F.col("parse") >= 55
    return sources.agg(
        F.count(F.lit(1)).alias("new_sources"), (F.count(F.lit(1)) + known).alias("all_sources"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("exchange_shop", "regional_market_channel", "settlement_exchange")],
        F.count_if(good & F.col("kind").isin("exchange_shop", "regional_market_channel", "settlement_exchange")).alias("publishable"), F.coalesce(F.sum(F.when(good, F.greatest(F.lit(1), F.least("quotes", F.lit(5)) + F.col("pairs")))), F.lit(0)).alias("records"),
    )


def business_summary(found: DataFrame, known: int) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("new"), F.count_if("shop").alias("shops"), F.count_if("rate_page").alias("rate_pages"), F.count_if("social").alias("social_feeds"), (F.count(F.lit(1)) + known).alias("all_sources"))


def review_summary(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The names of each use of reviewed candidates (name, use, numeric, remittance), and how many records those fit to publish have."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    listed = rows.agg(*[names(F.col("use") == u).alias(u) for u in ("publishable", "monitor_only", "stale", "no_usable_signal")], names(F.col("numeric") > 0).alias("numeric"), names(F.col("remittance")).alias("remittance"))
    n = records.join(rows.where("use = 'publishable'").select("name").distinct(), "name", "left_semi").agg(F.count(F.lit(1)).alias("records"))
    return listed.crossJoin(n)


def remembered(sources: DataFrame, useful: Column, places: list[Column]) -> DataFrame:
    """locality and n: useful sources of a registry by the first of several columns that names a place."""
    return sources.where(useful).select(F.coalesce(*places).alias("locality")).where("locality IS NOT NULL").groupBy("locality").agg(F.count(F.lit(1)).alias("n"))


def best_freshness(records: DataFrame, key: str, fallback: Column) -> DataFrame:
    """key and the best of its records' freshness; where none is known, the fallback."""
    rank = F.when(F.col("freshness") == "fresh", 3).when(F.col("freshness") == "recent", 2).when(F.col("freshness") == "stale", 1)
    per = records.groupBy(key).agg(F.max_by(F.when(rank.isNotNull(), F.col("freshness")), rank).alias("best"), F.first(fallback).alias("other"))
    return per.select(key, F.coalesce("best", "other").alias("freshness"))


def fresh_ids(sources: DataFrame, now: Column, hours: int = 30) -> DataFrame:
    """locality and the sorted ids of its sources that were seen in the last hours, not in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp("seen")
    return sources.where(age.between(0, hours * 3600)).groupBy("locality").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def fresh_fallback(cards: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cards (locality, sources, fresh_count, fresh_sources) without fresh sources get those of theirs that the registry saw lately."""
    both = F.array_sort(F.array_intersect(F.array_distinct("sources"), F.coalesce("ids", F.array().cast("array<string>"))))
    j = joined(cards, fresh, ["locality"]).withColumn("_both", both)
    take = (F.col("fresh_count") <= 0) & (F.size("_both") > 0)
    return j.withColumns({"fresh_count": F.when(take, F.size("_both")).otherwise(F.col("fresh_count")), "fresh_sources": F.when(take, F.col("_both")).otherwise(F.col("fresh_sources"))}).drop("ids", "_both")


def merge_richer(ours: DataFrame, extra: DataFrame) -> DataFrame:
    """handle, title, kind, density, url of both: what the first doesn't know or says plainly comes from the second."""
    a, b = ours.alias("a"), extra.alias("b")
    j = a.join(b, F.col("a.handle") == F.col("b.handle"), "full")
    bare = F.col("a.kind").isin("unknown", "aggregator") & ~F.col("b.kind").isin("unknown", "aggregator")
    plain = F.col("a.url").endswith(F.concat(F.lit("/"), F.col("a.handle"))) & (F.col("b.url") != "")
    pick = lambda c, when: F.when(F.col("a.handle").isNull() | F.coalesce(when, F.lit(False)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return j.select(
        F.coalesce("a.handle", "b.handle").alias("handle"), pick("title", (F.coalesce("a.title", F.lit("")).isin("") | (F.col("a.title") == F.col("a.handle"))) & F.col("b.handle").isNotNull()).alias("title"), pick("kind", bare).alias("kind"),
        pick("density", F.col("b.density") > F.col("a.density")).alias("density"), pick("url", plain).alias("url"),
    )


def merge_businesses(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """One row per key: the longest name (the first of equals), the first website, country and kind that are known, any flag, the highest score, all origins."""
    known = lambda c, none: F.min_by(F.when(F.coalesce(F.col(c), F.lit(none)) != none, F.col(c)), F.when(F.coalesce(F.col(c), F.lit(none)) != none, F.col(ordinal)))
    return rows.withColumn("_key", key).where("_key IS NOT NULL").groupBy("_key").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col(ordinal))).alias("name"), F.coalesce(known("website", ""), F.lit("")).alias("website"), F.coalesce(known("country", "unknown"), F.lit("unknown")).alias("country"), F.coalesce(known("kind", "unknown"), F.lit("unknown")).alias("kind"),
        F.bool_or("shop").alias("shop"), F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("origins", r"\|"), lambda x: x != ""))))), "|").alias("origins"),
    ).withColumnRenamed("_key", "key")


def seeds_of_survey(channels: DataFrame, places: Column) -> DataFrame:
    """Trade channels that name a place: handle, kind."""
    return channels.where(F.col("kind").isin(*TRADE_CHANNELS) & (F.size(places) > 0)).where("handle <> '' AND url <> ''").select(F.lower(F.trim("handle")).alias("handle"), "kind", F.lit("existing_registry").alias("origin"))


def seeds_of_candidates(rows: DataFrame) -> DataFrame:
    """Earlier candidates that had any quote or board: handle, kind."""
    handle = F.lower(F.trim("handle"))
    return rows.where(handle.rlike(HANDLE) & ((F.col("quotes") > 0) | (F.col("boards") > 0))).select(handle.alias("handle"), F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("regional_market_channel")).alias("kind"), F.lit("previous_candidate_registry").alias("origin"))


def seeds_of_registry(sources: DataFrame) -> DataFrame:
    """Sources of a registry with a handle of the usual form: handle, kind."""
    handle = F.lower(F.trim("handle"))
    return sources.where(handle.rlike(HANDLE)).select(handle.alias("handle"), F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("regional_market_channel")).alias("kind"))


def select_candidates(rows: DataFrame, hint: Column, existing: DataFrame) -> DataFrame:
    """handle, kind and density of candidates with a hint, of useful boards, and of what is there already; those that only are there get what is usual."""
    useful = F.col("kind").isin("regional_fx_board", "regional_market_channel") & ((F.col("boards") > 0) | (F.col("places") >= 2))
    known = existing.select(F.lower(F.trim("handle")).alias("handle")).where("handle <> ''").distinct()
    j = rows.withColumn("handle", F.lower(F.trim("handle"))).where("handle <> ''").join(known.withColumn("_known", F.lit(True)), "handle", "full")
    return j.where(F.coalesce(hint, F.lit(False)) | F.coalesce(useful, F.lit(False)) | F.col("_known")).select("handle", F.coalesce("kind", F.lit("regional_market_channel")).alias("kind"), F.coalesce("density", F.lit(70.0)).alias("density"))


def registry_updates(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """handle, usable and localities: the records of a candidate, and the places that it and they name."""
    per = records.groupBy("handle").agg(F.count(F.lit(1)).alias("usable"), F.collect_set("locality").alias("_seen"))
    none = F.array().cast("array<string>")
    return joined(candidates, per, ["handle"]).select("handle", F.coalesce("usable", F.lit(0)).alias("usable"), F.array_sort(F.array_union(F.coalesce("mentions", none), F.coalesce("_seen", none))).alias("localities"))


def watchlist(reviews: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Stale reviews (name, use, freshness) with when they were last seen and what their records quote."""
    per = records.groupBy("name").agg(F.max("at").alias("_at"), F.bool_or(F.col("currency") == "USD").alias("usd"), F.bool_or(F.col("currency") == "AED").alias("aed"), F.bool_or("remittance").alias("remit"))
    j = joined(joined(reviews.where("use = 'stale'"), candidates.select("name", "last_seen"), ["name"]), per, ["name"])
    no = F.lit(False)
    return j.select("name", "freshness", F.greatest("last_seen", "_at").alias("last_seen"), F.coalesce("usd", no).alias("usd"), F.coalesce("aed", no).alias("aed"), F.coalesce("remit", no).alias("remit"))


def day_files_over_series(days: DataFrame, series: DataFrame) -> DataFrame:
    """day and value: of a day in both, what its own file says, unless that has no value."""
    both = days.select("day", "value", F.lit(1).alias("_own")).unionByName(series.select("day", "value", F.lit(0).alias("_own"))).where("value IS NOT NULL")
    return both.groupBy("day").agg(F.max_by("value", F.struct("_own", "value")).alias("value"))


def stale_mappings(days: DataFrame, current: str) -> DataFrame:
    """Days that were made under another mapping, or without one."""
    return days.where(~F.col("fingerprint").eqNullSafe(F.lit(current)))


def daily_history(values: DataFrame) -> DataFrame:
    """day, eligible and excluded sources, sorted, of a day's source values (source, included)."""
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("source"))))
    inside = F.coalesce("included", F.lit(False))
    return values.groupBy("day").agg(names(inside).alias("eligible"), names(~inside).alias("excluded"), F.count_if(inside).alias("source_count"))


def representative(values: Column, families: Column, primary: str = "open_market") -> Column:
    """The benchmark that stands for a source: the primary one if it has it, else the first of its families with a positive value."""
    valued = F.filter(families, lambda f: F.try_element_at(values, f) > 0)
    return F.when(F.array_contains(valued, primary), primary).otherwise(F.get(valued, F.lit(0)))


def top_sources(records: DataFrame, basket: str, source: str, weight: str, most: int = 3) -> DataFrame:
    """basket and its heaviest sources, in order."""
    per = records.groupBy(basket, source).agg(F.sum(weight).alias("_w"))
    k = F.row_number().over(Window.partitionBy(basket).orderBy(F.col("_w").desc(), source))
    return per.withColumn("_k", k).where(F.col("_k") <= most).groupBy(basket).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", source))), lambda x: x[source]).alias("top"))


def primary_surface(surfaces: DataFrame, key: str) -> DataFrame:
    """key and kind:url of the surface with the most usable records, then the top score, then the last kind by name."""
    best = F.max_by(F.concat_ws(":", "kind", "url"), F.struct("usable", "score", "kind", "url"))
    return surfaces.groupBy(key).agg(best.alias("surface"))


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """Of each day the attempt collected last (day, at, ...), the greatest of equals."""
    cols = [c for c in attempts.columns if c not in ("day", "at")]
    return attempts.groupBy("day").agg(F.max(F.struct("at", *cols)).alias("_a")).select("day", "_a.*")


def capped(candidates: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first so many candidates; a sort of the first ones of each task, not of all."""
    return candidates.orderBy(*order).limit(most)


def query_plan(queries: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """Each query once, where it came first."""
    return queries.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*queries.columns), ordinal).alias("_q")).select("_q.*")


def by_eligibility(sources: DataFrame) -> DataFrame:
    """One row with the sorted names of sources (source, eligible) that count and of those that only serve diagnostics."""
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("source"))))
    return sources.agg(names(F.col("eligible")).alias("eligible"), names(~F.coalesce("eligible", F.lit(False))).alias("diagnostic_only"))


def with_selection(days: DataFrame) -> DataFrame:
    """Days (day, fix, n_sources, used, previous_fix, delta, same) with what of the selection isn't there filled in: sources used, the last day's fix, the difference."""
    before = F.lag("fix").over(Window.orderBy("day"))  # a row per day of the whole history: some thousands
    d = days.withColumn("_before", before)
    return d.select(
        "day", "fix", F.coalesce("used", "n_sources").alias("used"), F.coalesce("previous_fix", "_before").alias("previous_fix"), F.coalesce("delta", F.col("fix") - F.col("_before")).alias("delta"), F.coalesce("same", F.col("fix") == F.col("_before")).alias("same")
    )
