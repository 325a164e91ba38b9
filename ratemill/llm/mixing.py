"""Mixing sources to target weights by subset-sum budget fitting.

A document's length is its exact number of tokens (byte-pair encoding). Each source has a budget of tokens, its share
of the total. Per source, the histogram of lengths decides how many documents of each length are taken: the same share
of every length first, and for the budget that this leaves a bounded-knapsack dynamic programme over the remaining
counts, which finds the largest sum of lengths that still fits. If smaller shares don't meet the budget exactly either, it
runs over all documents of the source, so the sum is the best there is, also of few long documents. Of each length the
documents with the smallest seeded hash are taken.

Total budget: the largest at which no source needs more tokens than it has, unless one is given; with a given total a
source that has too little gives all it has.

With temper given, a source weighs as much as its own tokens to that power, the total is the share keep of all tokens
unless it is given, and what sources with too little can't give is made up by the others in proportion to their
weights. So neither a tiny source nor many of them shrink the total. PRODUCTION is what the query and the pipeline use.

Defined results: rows equal in doc_id, source and text are one unit, as long as all of them together, and are taken or
left together; a NULL text has no tokens; units without tokens are taken, as they cost nothing; NULL is a source like any other. With weights
given, sources that they don't name have weight 0; without, all sources weigh the same. A document of any length is one
unit: one that is longer than its source's budget is left out. Equally long documents are ranked by the seeded hash of doc_id
and content, then by these. An empty table gives an empty one. mix() gives back all columns of docs, whatever their names.

Exactness: the best sum is proved unless over FEW_UNITS documents remain, no equal share is met, and both budget and rest
exceed LARGEST times the common divisor of the lengths; then the programme covers that much of the budget.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm.common import chunks, content_id, cut, in_arrow, pack, recent

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 1_009
#: Power of a source's own tokens that is its weight, and share of all tokens that is taken.
PRODUCTION = {"temper": 0.7, "keep": 0.9}
#: Tokens that equal shares may leave to the knapsack, to begin with; whole documents bring it below.
CELLS = 1 << 16
#: Units up to which all sums of either half are listed; sums (in multiples of their common divisor) of which a set is held,
#: 32 MB of bits; bits of sets that are held together to retrace a sum.
FEW_UNITS = 40
LARGEST = 1 << 28
TABLE_BITS = 1 << 28
#: Units of one source and length that one task ranks; larger classes are split by hash, and only the split that the cut runs through is ranked.
CLASS_ROWS = 100_000
CHUNK = 4 << 20
#: Distinct pieces that a worker remembers in each of two generations.
REMEMBERED = 120_000

_BESIDE_BLANKS = r"^[\s\v\x{85}\pZ]|[\s\v\x{85}\pZ]$|^$"
_ENCODERS: dict[str, object] = {}


def _encoder(path: str) -> object:
    if path not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(text: pa.Array, path: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text. A text is cut before every single blank that stands between two other characters, where
    the pattern always cuts too, and each distinct piece is encoded once."""
    encoding = _encoder(path)
    text = text.fill_null("") if text.null_count else text
    lists = pc.split_pattern(text, " ")
    pieces = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    n = len(text)
    coded = pieces.dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = np.asarray(coded.indices)
    first = np.zeros(len(ids), np.int64)
    first[at[:-1]] = 1
    odd = np.asarray(pc.match_substring_regex(coded.dictionary, _BESIDE_BLANKS), bool)  # beside these, blanks run together
    rough = np.add.reduceat(odd[ids], at[:-1]) > 0 if n else np.zeros(0, bool)
    code = ids * np.int64(2) + first
    seen = np.zeros(2 * len(words), bool)
    seen[code[~np.repeat(rough, np.diff(at))]] = True
    used = np.flatnonzero(seen)
    keys = [words[c >> 1] if c & 1 else " " + words[c >> 1] for c in used.tolist()]
    memory = recent(path, REMEMBERED)
    new = memory.missing(keys)
    known = memory.new
    encode = encoding._core_bpe.encode_ordinary if hasattr(encoding, "_core_bpe") else encoding.encode_ordinary
    known.update([(w, len(encode(w))) for w in new])
    counts = np.zeros(2 * len(words), np.int64)
    counts[used] = [known[w] for w in keys]
    total = np.add.reduceat(counts[code], at[:-1]) if n else np.zeros(0, np.int64)
    for i in np.flatnonzero(rough):
        total[i] = len(encoding.encode_ordinary(text[i].as_py()))
    return total


def lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, cid and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                n = count_tokens(batch.column("text"), tokenizer)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("cid"), pa.array(n)], names=["doc_id", "source", "cid", "n_tokens"])

    slim = docs.select("doc_id", "source", "text", content_id(docs["text"]).alias("cid"))
    ident = slim.schema["doc_id"].dataType.simpleString()
    return in_arrow(slim, run, f"doc_id {ident}, source string, cid binary, n_tokens bigint")


def fit_budget(lens: np.ndarray, counts: np.ndarray, budget: int, cells: int = CELLS) -> np.ndarray:
    """How many of each length to take, so that their sum is the largest that doesn't exceed budget.

    Equal shares of every length come first, and the programme runs over what rounding left; with smaller shares where that
    can't be met exactly. If no share meets it, it runs over all units, in place of the shares.
    """
    lens, counts = np.asarray(lens, np.int64), np.asarray(counts, np.int64)
    total = int((lens * counts).sum())
    if budget >= total:
        return counts.copy()
    unit = math.gcd(*(int(n) for n, c in zip(lens, counts) if n and c))
    goal = budget // unit * unit  # no sum can be nearer
    best, most = np.zeros_like(counts), -1
    for give_back in (1, 2, 4, 8, 0):
        share = budget // give_back if give_back else 0
        parts = [divmod(c * share, total) for c in counts.tolist()]
        take = np.where(lens > 0, np.array([q for q, _ in parts], np.int64), counts)
        left = budget - int((lens * take).sum())
        # one more of the lengths that rounding cut most, until the rest fits the table
        for i in sorted(range(len(lens)), key=lambda i: (-parts[i][1], -lens[i])):
            if left < cells:
                break
            if take[i] < counts[i] and 0 < lens[i] <= left:
                take[i] += 1
                left -= int(lens[i])
        # lengths beyond the table: whole documents, the longest first
        for i in np.argsort(-lens, kind="stable"):
            if left < cells or not lens[i]:
                break
            more = min(int(counts[i] - take[i]), max(0, left - cells // 2) // int(lens[i]))
            take[i] += more
            left -= more * int(lens[i])
        if left < cells:
            take += _nearest(lens, counts - take, left)
        got = int((lens * take).sum())
        if got > most:
            best, most = take, got
        if most == goal:
            return best
    return _fit_all(lens, counts, budget, best, unit)


def _fit_all(lens: np.ndarray, counts: np.ndarray, budget: int, near: np.ndarray, unit: int) -> np.ndarray:
    """The best sum over all units. Few units are halved and the sums of the halves matched. Else the programme runs over
    the budget, or, where that is less, over what is left out; it is parted so that only sets of sums are held, never a
    table. Where even a set would have over LARGEST sums, it runs over the part of near that is that large."""
    some = np.flatnonzero((lens > 0) & (counts > 0))
    free = np.where(lens > 0, 0, counts)
    short, have, total = lens[some] // unit, counts[some], int((lens[some] * counts[some]).sum()) // unit
    goal = budget // unit
    out = free.copy()
    if have.sum() <= FEW_UNITS:
        out[some] = _meet(short, have, goal)
    elif min(goal, total - goal + int(short.max())) <= LARGEST:
        if goal <= total - goal:
            out[some] = _nearest(short, have, goal)
        else:  # the least sum to leave out that is no less than total - goal
            out[some] = have - _nearest(short, have, total - goal, over=True)
    else:
        take = near[some].copy()
        left = goal - int((short * take).sum())
        for i in np.argsort(short, kind="stable"):  # give back short ones, of which most fit
            less = min(int(take[i]), max(0, LARGEST - left) // int(short[i]))
            take[i] -= less
            left += less * int(short[i])
        out[some] = take + _nearest(short, have - take, min(left, LARGEST))
    return out


def _meet(lens: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """As _nearest() for few units: all sums of either half."""
    own = np.repeat(np.arange(len(lens)), counts)
    halves = own[: len(own) // 2], own[len(own) // 2 :]
    sums = []
    for half in halves:
        x = np.zeros(1, np.int64)
        for i in half:
            x = np.concatenate([x, x + lens[i]])  # bit j of a sum's place says whether it has unit j
        sums.append(x)
    order = np.argsort(sums[1], kind="stable")
    fits = np.flatnonzero(sums[0] <= goal)
    at = np.searchsorted(sums[1][order], goal - sums[0][fits], "right") - 1
    k = int(np.argmax(sums[0][fits] + sums[1][order][at]))
    out = np.zeros_like(counts)
    for half, place in zip(halves, (int(fits[k]), int(order[at[k]]))):
        for j, i in enumerate(half):
            out[i] += place >> j & 1
    return out


def _nearest(lens: np.ndarray, counts: np.ndarray, goal: int, over: bool = False) -> np.ndarray:
    """Bounded knapsack: how many of each length make the largest sum up to goal, or, if over, the least from goal on.

    Bit s of a set says that the units so far can sum to s. A step adds one power of two of one length's units.
    """
    lens, counts = lens.tolist(), counts.tolist()
    high = goal + max(lens, default=0) if over else goal
    steps, rest, size = [], [min(c, high // n) if n else 0 for n, c in zip(lens, counts)], 1
    mixed = sorted(range(len(lens)), key=lambda i: i * 2654435761 & 0xFFFFFFFF)  # long and short ones in turn
    while any(rest):
        for i in mixed:
            if m := min(size, rest[i]):
                steps.append((i, m))
                rest[i] -= m
        size *= 2
    reach, used = 1, 0
    for i, m in steps:
        if reach >> goal & 1:
            break
        reach |= (reach << m * lens[i]) & ((1 << high + 1) - 1)
        used += 1
    at = goal + ((reach >> goal) & -(reach >> goal)).bit_length() - 1 if over else reach.bit_length() - 1
    del reach
    out = np.zeros(len(lens), np.int64)
    _retrace(lens, steps[:used], at, out)
    return out


def _retrace(lens: list[int], steps: list[tuple[int, int]], goal: int, out: np.ndarray) -> None:
    """Adds to out units of steps that sum to goal, which they can: each half of the steps is given its part of it."""
    if not goal or not steps:
        return
    if len(steps) * goal <= TABLE_BITS or len(steps) == 1:
        sets = [1]
        for i, m in steps:
            sets.append(sets[-1] | (sets[-1] << m * lens[i]) & ((1 << goal + 1) - 1))
        for (i, m), before in zip(reversed(steps), sets[-2::-1]):
            if not before >> goal & 1:
                out[i] += m
                goal -= m * lens[i]
        return
    half = len(steps) // 2
    sides = []
    for part in (steps[:half], steps[half:]):
        reach = 1
        for i, m in part:
            reach |= (reach << m * lens[i]) & ((1 << goal + 1) - 1)
        sides.append(np.frombuffer(reach.to_bytes(goal // 8 + 1, "little"), np.uint8))
    del reach
    for low in range(0, goal + 1, 1 << 20):
        width = min(1 << 20, goal + 1 - low)
        one = np.unpackbits(sides[0][low // 8 : (low + width + 7) // 8], bitorder="little")[:width]
        first = goal - low - width + 1  # the other side's sums that go with these, the last first
        two = np.unpackbits(sides[1][first // 8 : (first + width + 7) // 8 + 1], bitorder="little")[first % 8 : first % 8 + width][::-1]
        both = np.flatnonzero(one & two)
        if len(both):
            cut_at = low + int(both[0])
            break
    del sides, one, two
    _retrace(lens, steps[:half], cut_at, out)
    _retrace(lens, steps[half:], goal - cut_at, out)


def _weighed(has: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """source and budget: weights and total as given, else equal weights and the largest total that all sources can meet."""
    if weights is None:
        weighed = has.withColumn("weight", F.when(F.col("has") > 0, F.lit(1.0)).otherwise(0.0))
    else:
        named = has.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighed = has.join(named, has["source"].eqNullSafe(named["source"]), "left").select(has["source"].alias("source"), "has", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    every = Window.partitionBy()
    share = F.col("weight") / F.sum("weight").over(every)
    whole = F.lit(total).cast("double") if total is not None else F.min(F.when(F.col("share") > 0, F.col("has") / F.col("share"))).over(every)
    return weighed.withColumn("share", F.when(F.sum("weight").over(every) > 0, share)).withColumn("budget", F.coalesce(F.floor(F.col("share") * whole + 1e-6), F.lit(0)).cast("long")).select("source", F.least("budget", "has").alias("budget"))


def _tempered(has: DataFrame, temper: float, keep: float, total: int | None) -> DataFrame:
    """source and budget: min(has, level * has ** temper), level such that the budgets sum to the total."""
    every = Window.partitionBy()
    largest = Window.orderBy(F.col("has").desc(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = has.withColumn("weight", F.when(F.col("has") > 0, F.pow(F.col("has").cast("double"), F.lit(float(temper)))).otherwise(0.0)).withColumn("all", F.sum("has").over(every))
    whole = F.floor(F.col("all") * keep) if total is None else F.least(F.lit(total).cast("long"), F.col("all"))
    # were all smaller sources to give all they have, this level would do for the others; any such level is too low but the right one
    level = (whole - (F.col("all") - F.sum("has").over(largest))) / F.sum("weight").over(largest)
    filled = weighed.withColumn("level", F.when(F.col("weight") > 0, level)).withColumn("level", F.max("level").over(every))
    return filled.select("source", F.when(F.col("weight") > 0, F.least("has", F.floor(F.col("level") * F.col("weight") + 1e-6))).otherwise(0).cast("long").alias("budget"))


def plan(units: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temper: float | None = None, keep: float = 1.0) -> DataFrame:
    """source, n_tokens, n_units, take: how many units of each length each source gives."""
    bars = units.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_units"))
    has = bars.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_units")).alias("has"))
    if temper is not None:
        budgets = _tempered(has, temper, keep, total)
    else:
        budgets = _weighed(has, weights, total)
    sized = bars.alias("x").join(budgets.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source"))).select("x.source", "n_tokens", "n_units", "budget")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        return pdf.assign(take=fit_budget(pdf.n_tokens.to_numpy(), pdf.n_units.to_numpy(), int(pdf.budget.iloc[0])))[["source", "n_tokens", "n_units", "take"]]

    return sized.groupBy("source").applyInPandas(fit, "source string, n_tokens long, n_units long, take long")


def chosen(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, class_rows: int = CLASS_ROWS, temper: float | None = None, keep: float = 1.0) -> DataFrame:
    """doc_id, source, cid, n_tokens and n_rows of the units taken."""
    units = cut(lengths(docs, tokenizer).groupBy("doc_id", "source", "cid", F.col("n_tokens").alias("each")).agg(F.count(F.lit(1)).alias("n_rows")).select("doc_id", "source", "cid", F.expr("each * n_rows").alias("n_tokens"), "n_rows"))
    takes = cut(plan(units, weights, total, temper, keep))
    drawn = units.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "cid"))
    u, t = drawn.alias("u"), takes.alias("t")
    on = F.col("u.source").eqNullSafe(F.col("t.source")) & (F.col("u.n_tokens") == F.col("t.n_tokens"))
    ours = u.join(t, on).select("u.*", "take", "n_units", F.pmod(F.shiftright("draw", 20), F.ceil(F.col("n_units") / class_rows)).alias("part"))
    sure = ours.where("take = n_units")
    open_ = ours.where("take > 0 AND take < n_units")
    parts = open_.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n_part"))
    before = F.sum("n_part").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("s"), F.col("n_tokens").alias("l"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = open_.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("n_tokens") == F.col("l")) & (F.col("part") == F.col("p")))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("draw", "doc_id", "cid"))
    some = placed.where("before < take").withColumn("rank", rank).where("before + rank <= take")
    cols = ["doc_id", "source", "cid", "n_tokens", "n_rows"]
    return sure.select(*cols).unionByName(some.select(*cols))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER, temper: float | None = None, keep: float = 1.0) -> DataFrame:
    """The rows of docs that are taken, all columns as they are."""
    keyed = pack(docs, doc=docs["doc_id"], src=docs["source"], cid=content_id(docs["text"])).alias("d")
    ours = chosen(docs, weights, total, seed, tokenizer, temper=temper, keep=keep).select(F.col("doc_id").alias("a"), F.col("source").alias("b"), F.col("cid").alias("c"))
    same = F.col("doc").eqNullSafe(F.col("a")) & F.col("src").eqNullSafe(F.col("b")) & F.col("cid").eqNullSafe(F.col("c"))
    return keyed.join(ours, same, "left_semi").select("row.*")
