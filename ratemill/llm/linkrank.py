"""URL filters by link-graph propagation.

Hosts are the nodes; an edge leads from the host of a page to each other host that the page links to or names in a mail
address, weighted by the number of pages. Trust spreads along edges from trusted seeds, distrust against them
from blocked seeds, both as personalised PageRank: a walker follows an edge with probability DAMPING and else starts anew at a
seed. Ranks are divided by the largest of their kind; a host is blocked if its distrust is at least BLOCK and more
than its trust, trusted if its trust is at least TRUST and at least its distrust, else unknown. A host of blocked seeds is always blocked.

Defined results: NULL url or one without a host gives NULL host and verdict "unknown"; NULL html has no links; hosts are
lower-cased, without port and final dot; repeated rows of a page count once as a page each; without seeds of a kind its ranks are 0.
Html of any length is searched whole. Ties: a host whose trust equals its distrust is trusted if it is high enough. An empty table gives
an empty one. Columns but page_id, url and html aren't read.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.llm.common import cut

DAMPING = 0.85
ROUNDS = 40
#: Largest sum of changes of one kind of rank at which the spreading ends.
TOLERANCE = 1e-4
BLOCK = 0.05
TRUST = 0.001
#: Registered domains; a seed stands for the host itself and all below it.
BLOCKED = ("adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "ads-track.example.com", "spam-farm.example.org")
TRUSTED = ("example.org",)

LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//(?:[^/"'\s>@]*@)?([^/"'\s>?#:]+)"""
MAIL = r"(?i)[a-z0-9._%+-]@([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"


def tidy(host: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def host_of(url: Column) -> Column:
    return tidy(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1))


def edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight of all host edges."""
    named = F.array_distinct(F.transform(F.concat(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(MAIL), F.lit(1))), tidy))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(named).alias("dst"))
    return links.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _under(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | host.endswith("." + d)
    return hit


def ranks(links: DataFrame, hosts: DataFrame, trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust and seed (of the blocked) of every host."""
    nodes = hosts.select("host").unionByName(links.select(F.col("src").alias("host"))).unionByName(links.select(F.col("dst").alias("host"))).where("host IS NOT NULL").distinct()
    bad = _under(F.col("host"), blocked)
    seeds = nodes.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (_under(F.col("host"), trusted) & ~bad).alias("is")), F.struct(F.lit("distrust").alias("kind"), bad.alias("is")))).alias("s")).select("host", "s.kind", F.col("s.is").cast("double").alias("seed"))
    totals = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.sum("seed").alias("n")).collect()}
    share = F.lit(0.0)
    for kind, n in totals.items():
        share = F.when(F.col("kind") == kind, F.col("seed") / F.lit(n or 1.0)).otherwise(share)
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    # arcs lie by host once for all rounds; what an executor loses of them is read again from the shared folder
    arcs = cut(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all")).alias("part"))).repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "host").persist(StorageLevel.DISK_ONLY)
    start = seeds.join(out.select("kind", F.col("src").alias("host"), F.lit(True).alias("leads")), ["kind", "host"], "left").select("kind", "host", share.alias("seed"), F.coalesce("leads", F.lit(False)).alias("leads"))
    state = cut(start.select("kind", "host", "seed", "leads", F.col("seed").alias("rank")))
    stray = F.sum(F.when(~F.col("leads"), F.col("rank")).otherwise(0.0)).alias("n")  # rank of hosts from which nothing leads starts anew
    loose = {r["kind"]: r["n"] for r in state.groupBy("kind").agg(stray).collect()}
    for _ in range(rounds):
        lost = F.lit(0.0)
        for kind, n in loose.items():
            lost = F.when(F.col("kind") == kind, F.lit(n)).otherwise(lost)
        given = state.join(arcs, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("part")).alias("given"))
        new = F.lit(1 - damping) * F.col("seed") + F.lit(damping) * (F.coalesce("given", F.lit(0.0)) + lost * F.col("seed"))
        moved = cut(state.join(given, ["kind", "host"], "left").select("kind", "host", "seed", "leads", new.alias("rank"), F.abs(new - F.col("rank")).alias("step")))
        seen = moved.groupBy("kind").agg(stray, F.sum("step").alias("step")).collect()
        loose = {r["kind"]: r["n"] for r in seen}
        state = moved.drop("step")
        if max((r["step"] for r in seen), default=0.0) <= tolerance:
            break
    arcs.unpersist()
    tops = state.groupBy("kind").agg(F.max("rank").alias("top"))
    scaled = state.join(F.broadcast(tops), "kind").select("host", "kind", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("rank"))
    per = scaled.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.max(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    return per.select("host", "trust", "distrust", _under(F.col("host"), blocked).alias("seed"))


def verdicts(per_host: DataFrame, block: float = BLOCK, trust: float = TRUST) -> DataFrame:
    bad = F.col("seed") | ((F.col("distrust") >= block) & (F.col("distrust") > F.col("trust")))
    good = (F.col("trust") >= trust) & (F.col("trust") >= F.col("distrust"))
    return per_host.select("host", "trust", "distrust", F.when(bad, "blocked").when(good, "trusted").otherwise("unknown").alias("verdict"))


def filter_urls(pages: DataFrame, trusted: tuple[str, ...] = TRUSTED, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, url, host, trust, distrust and verdict of every page."""
    slim = pages.select("page_id", "url", "html")
    links = cut(edges(slim))
    placed = slim.select("page_id", "url", host_of(F.col("url")).alias("host"))
    judged = verdicts(ranks(links, placed.select("host").distinct(), trusted, blocked))
    return placed.join(judged, "host", "left").select("page_id", "url", "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), F.coalesce("verdict", F.lit("unknown")).alias("verdict"))
