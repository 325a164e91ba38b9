"""Values out of free-form JSON: every leaf with its path, symbols by their names, quote times by their paths.

Payloads are variants, parsed once and flattened level by level to a given depth within their row; objects deeper than that are
left out. Only what is found under a key moves, once, to where the rows of that key meet.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratemill.functions import numbers, text, times
from ratemill.operators.quotes import once

QUOTE_FIELDS = tuple("value price last close sell buy rate amount p".split())
NAME_FIELDS = tuple("code id item label name slug symbol title".split())
TIME_FIELDS = tuple("timestamp ts updated updated_at time date".split())
DEPTH = 8


#: Whatever numbers.parse_number() reads has no other characters.
_DIGITS = rf"^[-+.,٬، 0-9{numbers.EASTERN}]+$"


def _node(path: Column, name: Column, node: Column) -> Column:
    """A value: where it stands, under what name, itself (a variant), and its fields or items if it is an object or an array."""
    return F.struct(path.alias("path"), name.alias("name"), node.alias("node"), F.try_variant_get(node, "$", "map<string, variant>").alias("fields"), F.try_variant_get(node, "$", "array<variant>").alias("items"))


def _inside(x: Column) -> Column:
    """The values one level below a value."""
    fields = F.transform(F.map_entries(x["fields"]), lambda e: _node(F.when(x["path"] == "", e["key"]).otherwise(F.concat(x["path"], F.lit("."), e["key"])), e["key"], e["value"]))
    items = F.transform(x["items"], lambda v, i: _node(F.concat(x["path"], F.lit("["), i, F.lit("]")), F.lit(None).cast("string"), v))
    return F.coalesce(fields, items, F.slice(F.array(x), 1, 0))


def tree(body: Column, depth: int = DEPTH, paths: bool = True) -> Column:
    """An array with every value in a JSON text, level by level; an empty one if it is no JSON. Without paths, all are NULL."""
    roots = F.transform(F.filter(F.array(F.try_parse_json(body)), lambda v: v.isNotNull()), lambda v: _node(F.lit("" if paths else None).cast("string"), F.lit(None).cast("string"), v))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(roots), lambda done, _: F.concat(done, F.array(F.flatten(F.transform(F.element_at(done, -1), _inside))))) if depth > 0 else F.array(roots)
    return F.flatten(levels)


def _trees(df: DataFrame, key: Column, body: str, depth: int, paths: bool = True) -> DataFrame:
    """key and nodes: the tree of each row, worked out once."""
    return once(df.select(key.alias("key"), F.col(body).alias("_body")), nodes=tree(F.col("_body"), depth, paths)).select("key", "nodes")


def _leaves(nodes: Column) -> Column:
    return F.filter(nodes, lambda x: x["fields"].isNull() & x["items"].isNull())


def _plain(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def leaves(df: DataFrame, key: str, body: str, depth: int = DEPTH) -> DataFrame:
    """key, path and value (as text) of every scalar."""
    each = F.transform(_leaves(F.col("nodes")), lambda x: F.struct(x["path"].alias("path"), _plain(x["node"]).alias("value")))
    return _trees(df, F.col(key), body, depth).select("key", F.inline(each))


def _tokens(symbols: Iterable[str]) -> dict[str, str]:
    """The first symbol of each token."""
    return {"".join(c for c in s.lower() if c.isascii() and c.isalnum()): s for s in reversed(tuple(symbols))}


def _numbers(texts: Column) -> Column:
    """numbers.parse_number() of each text, without those that are none; every step is worked out once."""
    bare = F.filter(F.transform(F.filter(texts, lambda t: t.rlike(_DIGITS)), numbers.bare_number), lambda b: b.rlike(numbers.DECIMAL))
    return F.filter(F.transform(bare, lambda b: b.try_cast("double")), lambda v: v > 0)


def symbol_hits(nodes: Column, symbols: Iterable[str], number: bool = True, time: bool = True) -> Column:
    """token, v and at of every place in a tree where a symbol stands, as a name or as the label of an object: its number and its time,
    NULL where there is none or it isn't asked for."""
    wanted = tuple(_tokens(symbols))
    # what a text with one of the tokens looks like: few texts do, and only theirs are worked out
    like = "^[^a-z0-9]*(?:" + "|".join("[^a-z0-9]*".join(t) for t in wanted) + ")[^a-z0-9]*$"
    met_in = lambda texts: F.filter(F.transform(F.filter(texts, lambda t: F.lower(t).rlike(like)), text.symbol_token), lambda t: t.isin(*wanted))
    field = lambda x, names: F.array_compact(F.transform(F.array(*[F.lit(f) for f in names]), lambda f: _plain(F.try_element_at(x["fields"], f))))
    own = lambda x: met_in(F.array(x["name"]))
    labels = lambda x: F.array_distinct(met_in(F.transform(F.filter(F.map_entries(x["fields"]), lambda e: e["key"].isin(*NAME_FIELDS)), lambda e: _plain(e["value"]))))
    texts = lambda x, names: F.when(x["fields"].isNull(), F.array_compact(F.array(_plain(x["node"])))).otherwise(field(x, names))
    v = lambda x: F.get(_numbers(texts(x, QUOTE_FIELDS)), F.lit(0)) if number else F.lit(None).cast("double")
    at = lambda x: F.get(F.array_compact(F.transform(texts(x, TIME_FIELDS), times.parse_time)), F.lit(0)) if time else F.lit(None).cast("timestamp")
    some = F.filter(nodes, lambda x: x["fields"].isNotNull() | F.lower(x["name"]).rlike(like))
    met = F.transform(some, lambda x: F.struct(F.when(x["fields"].isNull(), own(x)).otherwise(F.concat(own(x), labels(x))).alias("tokens"), x["node"].alias("node"), x["fields"].alias("fields")))
    told = F.transform(F.filter(met, lambda x: F.size(x["tokens"]) > 0), lambda x: F.struct(x["tokens"].alias("tokens"), v(x).alias("v"), at(x).alias("at")))
    return F.flatten(F.transform(told, lambda x: F.transform(x["tokens"], lambda t: F.struct(t.alias("token"), x["v"].alias("v"), x["at"].alias("at")))))


def _gathered(df: DataFrame, key: str, body: str, depth: int, symbols: Iterable[str] = (), benchmarks: Iterable[str] = (), least: int = 4, number: bool = True, time: bool = True) -> DataFrame:
    """key, hits (those of all of the key's rows) and, under each benchmark's name, points, path and v of its best path: of all keys that have any."""
    symbols, benchmarks = tuple(symbols), tuple(dict.fromkeys(benchmarks))
    hits = F.filter(symbol_hits(F.col("nodes"), symbols, number, time), lambda h: h["v"].isNotNull() | h["at"].isNotNull()) if symbols else F.expr("CAST(array() AS array<struct<token: string, v: double, at: timestamp>>)")
    rows = once(_trees(df, F.col(key), body, depth, bool(benchmarks)), hits=hits, **{b: _best_path(F.col("nodes"), b, least) for b in benchmarks}).drop("nodes")
    some = F.size("hits") > 0
    for b in benchmarks:
        some = some | F.col(b).isNotNull()
    return rows.where(some).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("hits"), *[F.min(b).alias(b) for b in benchmarks])


def _median(values: Column) -> Column:
    """As F.median() of what an array has."""
    at = lambda s, i: F.get(s, F.floor(i / 2).cast("int"))
    mid = lambda s: F.transform(F.array(F.struct(at(s, F.size(s) - 1).alias("a"), at(s, F.size(s)).alias("b"))), lambda x: F.when(x["a"] == x["b"], x["a"]).otherwise(0.5 * x["a"] + 0.5 * x["b"]))[0]
    return F.transform(F.array(F.array_sort(F.array_compact(values))), mid)[0]


def _of(hits: Column, tokens: Iterable[str], what: str) -> Column:
    return F.transform(F.filter(hits, lambda h: h["token"].isin(*tokens)), lambda h: h[what])


def _prior(hits: Column, symbols: tuple[str, ...]) -> Column:
    """v and symbol: of the symbols that have a value, the one with the latest time of its own, the first of equals; NULL without any."""
    each = [F.struct(_median(_of(hits, [t], "v")).alias("v"), F.array_max(_of(hits, [t], "at")).alias("at"), F.lit(-symbols.index(s)).alias("place"), F.lit(s).alias("symbol")) for t, s in _tokens(symbols).items()]
    rank = lambda x: F.struct(x["at"].isNotNull().alias("timed"), F.coalesce(x["at"], F.lit("1970-01-01").cast("timestamp")).alias("at"), x["place"].alias("place"), x["v"].alias("v"), x["symbol"].alias("symbol"))
    return F.array_max(F.transform(F.filter(F.array(*each), lambda x: x["v"].isNotNull()), rank))


def symbol_value(df: DataFrame, key: str, body: str, symbols: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """key and the median of all positive numbers that stand under a symbol: as its value, or in an object named or labelled by it."""
    return _gathered(df, key, body, depth, symbols, time=False).select("key", _median(F.transform("hits", lambda h: h["v"])).alias("value"))


def symbol_time(df: DataFrame, key: str, body: str, symbols: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """key and the latest time that stands under a symbol."""
    return _gathered(df, key, body, depth, symbols, number=False).select("key", F.array_max(F.transform("hits", lambda h: h["at"])).alias("quote_time"))


def by_priority(df: DataFrame, key: str, body: str, symbols: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """key, value and symbol: of the symbols that have a value, the one with the latest time of its own, the first of equals."""
    best = once(_gathered(df, key, body, depth, symbols), b=_prior(F.col("hits"), symbols))
    return best.where("b IS NOT NULL").select("key", F.col("b.v").alias("value"), F.col("b.symbol").alias("symbol"))


_SAYS = {
    "usd": "usd", "irr": "irr|rial", "sell": "sell|offer", "buy": "buy|bid", "open": "open|market|street|free|azad", "tether": "usdt|tether", "coin": "emami|sekke|coin", "gold": "gold|tala", "official": "official|bank|cbi|gov", "transfer": "transfer|hawala|remit", "price": r"price|\.value$",
}
#: Per benchmark: what a path must say, the points for what it says, and the bounds of a likely value.
_POINTS = {
    "open_market": (None, {"usd": 4, "irr": 4, "open": 3, "sell": 1, "buy": -1, "price": 1}, 0, (150_000, 2_500_000)), "official": ("official", {"usd": 4, "irr": 4, "price": 1}, 3, (10_000, 2_500_000)), "regional_transfer": ("transfer", {"usd": 4, "irr": 4, "price": 1}, 3, (150_000, 2_500_000)),
    "crypto_usdt": ("tether", {"irr": 3, "usd": 1, "price": 1}, 5, (150_000, 2_500_000)), "emami_gold_coin": ("coin|gold", {"coin": 4, "gold": 2, "price": 1}, 0, (5_000_000, 20_000_000_000)),
}


def _said(low: Column, what: str) -> Column:
    """Whether a path in lower case says it: plain words are looked for as such."""
    return functools.reduce(operator.or_, [low.contains(w) if w.isalnum() else low.rlike(w) for w in _SAYS[what].split("|")])


def _best_path(nodes: Column, benchmark: str, least: int) -> Column:
    """points (negative), path and v of the number whose path speaks most for a benchmark, of equals the first path by name; NULL without one."""
    must, says, flat, bounds = _POINTS[benchmark]

    def points(x: Column) -> Column:
        n = F.lit(flat) + F.when(x["v"].between(*bounds), 2).otherwise(0)
        for what, more in says.items():
            n = n + F.when(_said(x["low"], what), more).otherwise(0)
        return n

    plain = F.filter(F.transform(_leaves(nodes), lambda x: F.struct(x["path"].alias("path"), _plain(x["node"]).alias("plain"))), lambda x: x["plain"].rlike(_DIGITS))
    bare = F.transform(plain, lambda x: F.struct(x["path"].alias("path"), numbers.bare_number(x["plain"]).alias("bare")))
    told = F.filter(F.transform(F.filter(bare, lambda x: x["bare"].rlike(numbers.DECIMAL)), lambda x: F.struct(x["path"].alias("path"), F.lower(x["path"]).alias("low"), x["bare"].try_cast("double").alias("v"))), lambda x: x["v"] > 0)
    if must:
        told = F.filter(told, lambda x: functools.reduce(operator.or_, [_said(x["low"], m) for m in must.split("|")]))
    return F.array_min(F.filter(F.transform(told, lambda x: F.struct((-points(x)).alias("points"), x["path"].alias("path"), x["v"].alias("v"))), lambda x: x["points"] <= -least))


def path_value(df: DataFrame, key: str, body: str, benchmark: str, depth: int = DEPTH, least: int = 4) -> DataFrame:
    """key and the number whose path speaks most for a benchmark, at least so many points; of equals the first path by name."""
    return _gathered(df, key, body, depth, (), (benchmark,), least).select("key", F.col(benchmark)["v"].alias("value"))


#: Ways to resolve a payload: a benchmark, the source's own symbols, any symbols of the benchmark, and whether only its own may do.
Way = tuple[str, tuple[str, ...], tuple[str, ...], bool]


def resolved_ways(df: DataFrame, key: str, body: str, ways: dict[str, Way], depth: int = DEPTH) -> DataFrame:
    """key, way, value and symbol of each way that gives a value, as resolved(); payloads are read once for all ways."""
    symbols = dict.fromkeys(s for _, own, some, strict in ways.values() for s in (own if strict else own + some))
    found = _gathered(df, key, body, depth, symbols, [w[0] for w in ways.values() if not w[3]])
    none = F.lit(None).cast("string")
    pair = lambda v, symbol: F.struct(v.alias("value"), symbol.alias("symbol"))
    one = lambda x, use: F.get(F.transform(F.filter(F.array(x), lambda y: y.isNotNull()), use), F.lit(0))
    each = []
    for name, (benchmark, own, some, strict) in ways.items():
        steps = [one(_prior(F.col("hits"), own), lambda x: pair(x["v"], x["symbol"]))] if own else []
        if not strict:
            steps += [one(_median(_of(F.col("hits"), _tokens(some), "v")), lambda v: pair(v, none))] if some else []
            steps.append(one(F.col(benchmark), lambda x: pair(x["v"], none)))
        if steps:
            each.append(F.struct(F.lit(name).alias("way"), F.coalesce(*steps).alias("b")))
    if not each:
        return df.select(F.col(key).alias("key"), none.alias("way"), F.lit(None).cast("double").alias("value"), none.alias("symbol")).where("false")
    told = F.transform(F.filter(F.array(*each), lambda x: x["b"].isNotNull()), lambda x: F.struct(x["way"].alias("way"), x["b"]["value"].alias("value"), x["b"]["symbol"].alias("symbol")))
    return found.select("key", F.inline(told))


def resolved(df: DataFrame, key: str, body: str, benchmark: str, canonical: tuple[str, ...] = (), candidates: tuple[str, ...] = (), strict: bool = False, depth: int = DEPTH) -> DataFrame:
    """key, value and symbol: by the source's own symbols, else (unless strict) by any symbol of the benchmark, else by the path."""
    return resolved_ways(df, key, body, {benchmark: (benchmark, canonical, candidates, strict)}, depth).drop("way")


def product_price(df: DataFrame, key: str, html: str, depth: int = DEPTH) -> DataFrame:
    """key and the price of the first product that a page's linked data offers: the first script's, the least deep there."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    parts = df.select(F.col(key).alias("k"), F.posexplode(scripts).alias("i", "body"))
    products = F.filter("nodes", lambda x: F.lower(F.trim(_plain(F.try_element_at(x["fields"], F.lit("@type"))))) == "product")
    priced = F.transform(products, lambda x: F.struct(x["path"].alias("path"), _numbers(F.array_compact(F.array(F.try_variant_get(F.try_element_at(x["fields"], F.lit("offers")), "$.price", "string")))).alias("v")))
    far = lambda path: F.length(F.regexp_replace(path, r"[^.\[]", ""))
    each = F.transform(F.filter(priced, lambda x: F.size(x["v"]) > 0), lambda x: F.struct(F.col("key.i").alias("i"), far(x["path"]).alias("far"), x["path"].alias("path"), x["v"][0].alias("v")))
    best = once(_trees(parts, F.struct("k", "i"), "body", depth), b=F.array_min(each)).where("b IS NOT NULL")
    return best.groupBy(F.col("key.k").alias("key")).agg(F.min("b").alias("b")).select("key", F.col("b.v").alias("price"))


def quote_time(df: DataFrame, key: str, body: str, depth: int = DEPTH) -> DataFrame:
    """key and the time whose path speaks most for a quote time."""
    points = lambda p: F.when(p.contains("updated"), 3).otherwise(0) + F.when(p.contains("timestamp") | p.endswith(".ts"), 2).otherwise(0) + F.when(p.contains("usd"), 1).otherwise(0)
    named = F.filter(_leaves(F.col("nodes")), lambda x: F.lower(x["path"]).rlike("time|date|updated|timestamp|ts"))
    timed = F.filter(F.transform(named, lambda x: F.struct(points(F.lower(x["path"])).alias("points"), x["path"].alias("path"), times.parse_time(_plain(x["node"])).alias("at"))), lambda x: x["at"].isNotNull())
    best = once(_trees(df, F.col(key), body, depth), b=F.array_max(timed)).where("b IS NOT NULL")
    return best.groupBy("key").agg(F.max("b").alias("b")).select("key", F.col("b.at").alias("quote_time"))
