"""Windowed dedup of records, reposts across channels, upserts and keyed merges. Ties go to an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratemill.functions import numbers

EXACT_PENALTY, NEAR_PENALTY, REPOST_PENALTY = 22, 16, 18


def exact_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(numbers.western_digits(text)), r"\s+", " "))


def near_key(text: Column, length: int = 180) -> Column:
    """Numbers become #, long tokens @user, marks blanks; the first so many characters."""
    t = F.lower(numbers.western_digits(text))
    t = F.regexp_replace(t, numbers.NUMBER, "#")
    t = F.regexp_replace(t, r"[#@]?[_0-9a-z]{5,}", "@user")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}#]", " ")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, length)


def number_key(values: Column, most: int = 6) -> Column:
    """The first distinct numbers, joined."""
    return F.array_join(F.slice(F.array_distinct(values), 1, most), "|")


def in_channel(records: DataFrame, channel: str = "handle", ordinal: str = "msg_index", near: str = "near_sig", exact: str = "exact_key", score: str | None = None) -> DataFrame:
    """Adds keep, flag and, given a score, its reduced value: of records of a channel with one near signature the first is kept."""
    w = Window.partitionBy(channel, near).orderBy(ordinal)
    first = F.first(exact).over(w)
    kept = F.row_number().over(w) == 1
    flag = F.when(kept, "none").when(F.col(exact) == first, "exact_duplicate_in_channel").otherwise("near_duplicate_in_channel")
    out = records.select("*", kept.alias("keep"), flag.alias("flag"))
    if score:
        cut = F.when(F.col("flag") == "exact_duplicate_in_channel", EXACT_PENALTY).when(F.col("flag") == "near_duplicate_in_channel", NEAR_PENALTY).otherwise(0)
        out = out.withColumn(score, F.when(F.col("keep"), F.col(score)).otherwise(F.greatest(F.lit(0), F.col(score) - cut)))
    return out


def across_channels(records: DataFrame, key: str = "cross_key", channel: str = "handle", score: str = "score", priority: str = "priority", ordinal: str = "msg_index") -> DataFrame:
    """Of kept records with one key in several channels all but the best are reposts: no longer kept, flagged, their score reduced."""
    alive = Window.partitionBy(key, "keep")
    several = F.col("keep") & (F.min(channel).over(alive) < F.max(channel).over(alive))
    rank = F.row_number().over(alive.orderBy(F.col(score).desc(), F.when(F.col(priority) == "P1", 0).otherwise(1), channel, ordinal))
    repost = several & (rank > 1)
    marked = records.withColumn("_repost", repost)
    return marked.select(
        *[c for c in records.columns if c not in ("keep", "flag", score)],
        (F.col("keep") & ~F.col("_repost")).alias("keep"),
        F.when(~F.col("_repost"), F.col("flag")).when(F.col("flag") == "none", "reposted_cross_channel").otherwise(F.concat("flag", F.lit("|reposted_cross_channel"))).alias("flag"),
        F.when(F.col("_repost"), F.greatest(F.lit(0), F.col(score) - REPOST_PENALTY)).otherwise(F.col(score)).alias(score),
    )


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def by_content(df: DataFrame, but: list[str]) -> list[Column]:
    """An order of rows that are equal in all that counts, so that every run picks the same."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return [F.to_json(F.col(c)).desc() if kinds[c] in ("map", "variant") else F.col(c).desc() for c in sorted(df.columns) if c not in but]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; of several in one of them the greatest, column by column, stays."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return first_by(both, keys, [F.col("_seq").desc(), *by_content(old, keys)]).drop("_seq")


def rank_all(df: DataFrame, bucket: str, order: list[Column], name: str) -> DataFrame:
    """Adds the rank of every row by bucket, then by order: its rank within the bucket after the rows of all lesser buckets. The order has to tell all rows of a bucket apart."""
    sizes = df.groupBy(F.col(bucket).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = df.join(before, F.col(bucket).eqNullSafe(F.col("_b")))
    return joined.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).drop("_b", "_before")


def upsert_newest(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Of rows of a key one with a value beats one without, then the later one wins."""
    return first_by(rows, keys, [F.col(value).isNull(), F.col(seq).desc()])


def prune_days(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last so many days before the newest one; rows without a time stay. The newest time is a one-row aggregate: no single task sees all rows."""
    newest = rows.agg(F.max(ts).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col(ts).isNull() | F.col("_newest").isNull() | (F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(days - 1)))).drop("_newest")


def last_of_day(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each day and key."""
    return first_by(rows.withColumn("day", F.to_date(ts)), [key, "day"], [F.col(ts).desc(), *by_content(rows, [key, ts])])
