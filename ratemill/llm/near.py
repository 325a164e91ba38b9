"""Near dedup by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of K words, each labelled with its occurrence (first, second, ...). A sketch takes the
PICKS labelled k-mers that a seeded hash puts first and keeps them in text order, so that, unlike MinHash, it
is sensitive to order and thereby to edit similarity. Texts that share one of the SKETCHES sketches are compared with
the leader of that bucket, and those unlike it with all others of the bucket that they aren't joined with yet, by a banded
edit-distance alignment of their words: they are near copies if 1 - distance / words of the longer >= SIMILARITY.
Pairs whose lengths alone rule that out aren't aligned. Groups are the connected components.

Where a bucket holds many unlike texts, as when they share a license line, its pairs would grow with the square of them. The
texts of such buckets are aligned only where they share one of their rarest runs of words: of the runs of a fixed length into
which a text is cut up, d errors touch d at most, so that a near copy with d errors has one of any d + 1 of them, at most d words
away; those that the fewest of such texts have are taken, and of the lengths RUNS, by text, the one that they have least often.
So no near copy is lost, what a bucket's texts have in common doesn't pair them, and neither do words that all texts use.

Few words leave a sketch little to hold on to. Texts of up to EXACT_WORDS words therefore also meet under every
sequence of words that a near copy may have in common with them, which misses none, and texts of up to FEW_WORDS words
under sketches of SMALL_PICKS k-mers.

Defined results: a NULL text belongs to no group; texts that are equal, empty ones too, are one group; a text without
words has no sketch; a text of fewer than K words is one k-mer. A group is named by its smallest doc_id, NULL last,
and keeps one row, the first by (doc_id, content). Texts of any length are aligned whole. Equal rows are copies of each other; which of
rows equal in doc_id and text stays makes no difference but for their other columns, of which any row's stay. An empty table gives an
empty one. dedup() gives back all columns of docs, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm.common import chunks, content_id, cut, drop, in_arrow, mix, pack, seeded, span_hashes, spans, text_bytes, white, written

K = 2
PICKS = 3
SKETCHES = 24
SMALL_PICKS = 2
#: Texts of up to so many words also have sketches of SMALL_PICKS.
FEW_WORDS = 64
#: Pairs of texts of up to so many words are found without fail; at 14 words and 0.8 that takes 91 keys a text.
EXACT_WORDS = 14
SIMILARITY = 0.8
SEED = 20_240
#: Pairs of unlike texts of one bucket up to which all of them are aligned.
FEW_PAIRS = 1 << 10
#: Lengths of the runs of words by which texts of fuller buckets meet.
RUNS = (1, 2, 3)
#: Errors up to which alignment follows diagonals; beyond, it fills the band row by row.
FEW = 48
#: K-mers of a document that a sketch looks at on average; if fewer than PICKS of them are there, it looks at all.
NEAR_MIN = 16


def sketches(col: pa.Array, k: int = K, picks: int = PICKS, count: int = SKETCHES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the texts that have words, and their sketches, one row each."""
    data, at = text_bytes(col)
    starts, ends, first = spans(white(data), at)
    words = span_hashes(data, starts, ends)
    n_words = np.diff(first)
    rows = np.flatnonzero(n_words)
    if not len(rows):
        return rows, np.zeros((0, count), np.uint64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    grams = words.copy()
    last = first[1:][doc]  # where a document's words end
    idx = np.arange(len(words))
    for j in range(1, k):
        inside = idx + j < last
        grams[inside] = mix(grams[inside] * np.uint64(0x100000001B3) + words[np.minimum(idx + j, len(words) - 1)][inside])
    whole = (idx + k <= last) | (idx == first[doc])
    grams, doc, pos = grams[whole], doc[whole], idx[whole]
    base = _labelled(grams, doc)
    n_grams = np.bincount(doc, minlength=len(n_words))[rows]
    begin = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n_grams, out=begin[1:])
    dense = np.repeat(np.arange(len(rows)), n_grams)
    share = np.minimum(1.0, NEAR_MIN / n_grams)
    bound = np.where(share >= 1, float(2**64 - 2048), share * 2.0**64).astype(np.uint64)
    limit = bound[dense]
    out = np.empty((len(rows), count), np.uint64)
    for j, (a, b) in enumerate(seeded(seed, 2 * count).reshape(count, 2)):
        h = (base ^ b) * a
        h ^= h >> np.uint64(32)
        near = np.flatnonzero(h <= limit)
        have = np.bincount(dense[near], minlength=len(rows))
        for r in np.flatnonzero(have < np.minimum(picks, n_grams)):  # too few: look at all of them
            near = np.concatenate([near[(near < begin[r]) | (near >= begin[r + 1])], np.arange(begin[r], begin[r + 1])])
        by = np.lexsort((near, h[near], dense[near]))
        near = near[by]
        d = dense[near]
        rank = np.arange(len(near)) - np.searchsorted(d, np.arange(len(rows)))[d]
        near = np.sort(near[rank < picks])  # in text order
        d = dense[near]
        rank = np.arange(len(near)) - np.searchsorted(d, np.arange(len(rows)))[d]
        value = np.full(len(rows), np.uint64(j), np.uint64)
        for p in range(picks):
            here = near[rank == p]
            value[dense[here]] = mix(value[dense[here]] * np.uint64(0xFF51AFD7ED558CCD) + base[here])
        out[:, j] = value
    return rows, out


def _labelled(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """grams with their occurrence labels: equal ones of a document are told apart, in text order."""
    key = mix(grams ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    run = np.arange(len(order))
    labels = np.empty(len(order), np.uint64)
    labels[order] = run - np.maximum.accumulate(np.where(same, 0, run))
    return np.where(labels > 0, mix(grams + labels * np.uint64(0xD6E8FEB86659FD93)), grams)


def common_parts(col: pa.Array, similarity: float = SIMILARITY, longest: int = EXACT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the texts of 1 to longest words: two of them that are that similar share a key at least.

    If the longer has m words, they differ in most = (1 - similarity) * m words at most, so m - most words of either, in
    order, are those of the other. The keys are all sequences of so many words of a text, for each m that can be.
    """
    words, first = _words(col)
    words, n_words = words.view(np.uint64), np.diff(first)
    shared = [m - _most(m, similarity) for m in range(longest + 1)]
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, longest + 1):
        own = np.flatnonzero(n_words == n)
        if not len(own):
            continue
        grid = words[first[own][:, None] + np.arange(n)]
        for size in sorted({shared[m] for m in range(n, longest + 1) if shared[m] <= n}):
            picked = np.array(list(itertools.combinations(range(n), size)), np.int64).reshape(-1, size)
            key = np.full((len(own), len(picked)), np.uint64(0xC0FFEE + size), np.uint64)
            for j in range(size):
                key = mix(key * np.uint64(0x100000001B3) + grid[:, picked[:, j]])
            rows.append(np.repeat(own, len(picked)))
            keys.append(key.ravel())
    return np.concatenate(rows), np.concatenate(keys)


def _most(n: int, similarity: float) -> int:
    """Words in which near copies may differ if the longer has n, as in similar()."""
    return int((1 - similarity) * n + 1e-9)


def buckets(col: pa.Array, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, ascending, and all keys under which the texts meet others."""
    rows, values = sketches(col)
    n_words = np.diff(_words(col)[1])
    few = np.flatnonzero((n_words > 0) & (n_words <= FEW_WORDS))
    at, small = sketches(col.take(pa.array(few)), picks=SMALL_PICKS, seed=SEED + 1)
    short, parts = common_parts(col, similarity)
    row = np.concatenate([np.repeat(rows, values.shape[1]), np.repeat(few[at], small.shape[1]), short])
    key = np.concatenate([values.ravel(), small.ravel(), parts])
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _sketch_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks(whole, "text"):
            row, key = buckets(batch.column("text"), similarity)
            rows = np.unique(row)
            begin = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(begin), pa.array(key.view(np.int64)))
            n_words = np.diff(_words(batch.column("text"))[1])[rows]
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(rows)), pa.array(n_words), lists], names=["cid", "n", "sketch"])


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most most, else most + 1: alignment in a band that widens."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return min(len(a) + len(b), most + 1)
    least = _apart(a, b)
    if abs(len(a) - len(b)) > most or least > most:
        return most + 1
    if least <= FEW:
        got = _diagonals(a.tolist(), b.tolist(), min(most, FEW + FEW // 2))
        if got <= min(most, FEW + FEW // 2) or most <= FEW + FEW // 2:
            return min(got, most + 1)
    band = max(16, min(2 * least, most))
    while True:
        band = min(band, most)
        got = _banded(a, b, band)
        if got <= band or band >= most:
            return min(got, most + 1)
        band *= 4


def _diagonals(a: list, b: list, most: int) -> int:
    """Edit distance if at most most, else most + 1, along the diagonals of the band: how far each gets with 0, 1, ... errors."""
    n, m = len(a), len(b)
    goal = m - n
    none = -2
    far = [none] * (2 * most + 3)
    mid = most + 1
    for e in range(most + 1):
        new = [none] * (2 * most + 3)
        reach = most - e  # a diagonal farther from the goal than the errors left can't end there
        for k in range(max(-e, goal - reach), min(e, goal + reach) + 1):
            c = mid + k
            i = far[c] + 1  # another word
            if far[c - 1] > i:
                i = far[c - 1]  # a word more in b
            if far[c + 1] + 1 > i:
                i = far[c + 1] + 1  # a word more in a
            if e == 0:
                i = 0
            elif i < 0:
                continue
            if i > n:
                i = n
            j = i + k
            if j > m:
                i, j = m - k, m
            if j < 0:
                continue
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            new[c] = i
            if k == goal and i >= n:
                return e
        far = new
    return most + 1


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the distance: the words that one has and the other lacks."""
    _, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = ids.max() + 1
    diff = np.bincount(ids[: len(a)], minlength=n) - np.bincount(ids[len(a) :], minlength=n)
    return int(max(diff[diff > 0].sum(), -diff[diff < 0].sum()))


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Distance along paths that stay within band of the diagonal; exact if it is at most band."""
    if len(a) > len(b):
        a, b = b, a
    width = 2 * band + 1
    far = len(a) + len(b) + 1
    off = np.arange(width)
    padded = np.concatenate([np.full(band, -1, np.int64), b, np.full(band + len(a) + 1, -1, np.int64)])
    prev = np.where((off >= band) & (off - band <= len(b)), off - band, far).astype(np.int64)  # row 0: cell j is column j - band
    up = np.empty(width, np.int64)
    for i in range(1, len(a) + 1):
        cost = padded[i - 1 : i - 1 + width] != a[i - 1]  # column i + off - band compares b[i + off - band - 1]
        up[:-1], up[-1] = prev[1:] + 1, far
        cur = np.minimum(prev + cost, up)
        if i <= band:
            cur[: band - i] = far
            cur[band - i] = i
        over = len(b) - i + band + 1
        if over < width:
            cur[max(over, 0) :] = far
        cur -= off
        np.minimum.accumulate(cur, out=cur)
        cur += off
        prev = cur
        if prev.min() > band:
            return far
    end = len(b) - len(a) + band
    return int(prev[end]) if end < width else far


def similar(a: pa.Array, b: pa.Array, similarity: float) -> np.ndarray:
    """Whether the words of two texts are that similar, for each pair."""
    (x, at), (y, bt) = _words(a), _words(b)
    nx, ny = np.diff(at), np.diff(bt)
    most = ((1 - similarity) * np.maximum(nx, ny) + 1e-9).astype(np.int64)
    ok = np.abs(nx - ny) <= most
    for i in np.flatnonzero(ok).tolist():
        ok[i] = distance(x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]], int(most[i])) <= most[i]
    return ok


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_bytes(col)
    starts, ends, first = spans(white(data), at)
    return span_hashes(data, starts, ends).view(np.int64), first


def _compare(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b with ok: whether their texts are near copies."""
    with_a = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text_a"):
                ok = similar(batch.column("text_a"), batch.column("text_b"), similarity)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return in_arrow(both, verify, "a binary, b binary, ok boolean")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) for every node of the edges a, b."""
    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = cut(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        nearer = links.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("new"))
        step = roots.join(nearer, "node").select("node", F.least("root", "new").alias("root"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = cut(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old"))
        moved = now.where("root <> old").limit(1).count()
        roots = now.drop("old")
        if not moved:
            return roots


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of each of the lengths RUNS: their key, where they begin, and whether they are parts of the text cut up in runs of that length."""
    for whole in batches:
        for batch in chunks(whole, "text"):
            words, first = _words(batch.column("text"))
            words, n = words.view(np.uint64), np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(words)) - first[:-1][doc]
            for size in RUNS:
                at = np.flatnonzero(pos + size <= n[doc])
                key = np.full(len(at), np.uint64(0xC0FFEE + size), np.uint64)
                for j in range(size):
                    key = mix(key * np.uint64(0x100000001B3) + words[at + j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").take(pa.array(doc[at])), pa.array(key.view(np.int64)), pa.array(pos[at]), pa.array(np.full(len(at), size)), pa.array(pos[at] % size == 0)], names=["cid", "run", "pos", "size", "part"]
                )


def _rarest(runs: DataFrame, similarity: float) -> DataFrame:
    """The parts of each text of which one, at least, is in every near copy that isn't longer; only those that texts of other roots have, too."""
    own = runs.groupBy("run", "root").agg(F.count(F.lit(1)).alias("own"))
    often = own.groupBy("run").agg(F.sum("own").alias("times"))
    most = F.floor(F.lit(1 - similarity) * F.col("n") + 1e-9)  # as in similar(), of the longer
    parts = runs.where("part").withColumn("most", most).where(F.floor(F.col("n") / F.col("size")) > F.col("most")).join(own, ["run", "root"]).join(often, "run").withColumn("others", F.col("times") - F.col("own"))
    rank = F.row_number().over(Window.partitionBy("cid", "size").orderBy("others", "run", "pos"))
    kept = parts.withColumn("rank", rank).where(F.col("rank") <= F.col("most") + 1)
    each = kept.groupBy("cid", "size").agg(F.sum("others").alias("cost"), F.first(F.struct("n", "root", "open", "most")).alias("row"), F.collect_list(F.struct("run", "pos", "others")).alias("parts"))
    best = each.groupBy("cid").agg(F.min_by(F.struct("row", "parts"), F.struct("cost", "size")).alias("best"))
    return best.select("cid", "best.row.*", F.inline("best.parts")).where("others > 0").drop("others")


def crowded_pairs(crowd: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b of the contents of crowd (cid, n, root, open) that may be near copies, aren't joined yet, and of which one is open."""
    ours = texts.select("cid", "text").join(crowd.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    runs = written(in_arrow(ours, _run_batches, "cid binary, run bigint, pos bigint, size bigint, part boolean").join(crowd, "cid"))
    x = cut(_rarest(runs, similarity).select("run", *[F.col(c).alias(f"{c}_a") for c in ("cid", "n", "root", "open", "pos", "most")]))
    y = runs.select("run", *[F.col(c).alias(f"{c}_b") for c in ("cid", "n", "root", "open", "pos")])
    # roots meet first, so that texts of one root, of which there may be many, never do
    roots = x.select("run", "root_a").distinct().join(y.select("run", "root_b").distinct(), "run").where("root_a <> root_b")
    near = x.join(roots, ["run", "root_a"]).join(y, ["run", "root_b"]).where("(open_a OR open_b) AND n_b <= n_a AND n_a - n_b <= most_a AND abs(pos_a - pos_b) <= most_a")
    pairs = cut(near.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct())
    drop(runs)
    return pairs


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Every row with text as doc_id, cid; and cid, root of the contents that have near copies."""
    texts = docs.select(content_id(F.col("text")).alias("cid"), F.col("doc_id"), F.col("text")).where("text IS NOT NULL")
    sketched = in_arrow(texts.select("cid", "text"), functools.partial(_sketch_batches, similarity=similarity), "cid binary, n bigint, sketch array<bigint>")
    cells = written(sketched.select("cid", "n", F.explode("sketch").alias("bucket")).groupBy("bucket", "cid").agg(F.first("n").alias("n")))
    leaders = cells.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.col("least.cid").alias("a"), F.col("least.n").alias("n_a"))
    met = cut(cells.join(leaders, "bucket").where("cid <> a").select("bucket", "a", "n_a", F.col("cid").alias("b"), F.col("n").alias("n_b")))
    drop(cells)
    # texts move once; what is compared later comes from those that meet others
    some = met.select(F.col("a").alias("cid")).unionByName(met.select(F.col("b").alias("cid"))).distinct()
    held = written(texts.select("cid", "text").join(some, "cid", "left_semi").dropDuplicates(["cid"]))
    near_in_length = F.abs(F.col("n_a") - F.col("n_b")) <= F.floor(F.lit(1 - similarity) * F.greatest("n_a", "n_b") + 1e-9)  # as in similar()
    star = met.where(near_in_length).select("a", "b").distinct()
    first = cut(_compare(star, held, similarity))
    # those unlike their leader are compared with all of the bucket that they aren't joined with: no pair of a bucket is left open
    roots = components(first.where("ok")).select(F.col("node").alias("b"), "root")
    known = met.join(first.where("ok").select("a", "b", F.lit(True).alias("like")), ["a", "b"], "left").join(roots, "b", "left")
    members = cut(known.select("bucket", "b", "n_b", F.coalesce("like", F.lit(False)).alias("like"), F.coalesce("root", "b").alias("root")))
    sizes = members.groupBy("bucket").agg((F.count_if(~F.col("like")) * F.count(F.lit(1))).alias("pairs")).select("bucket", (F.col("pairs") > FEW_PAIRS).alias("crowded"))
    members = members.join(sizes, "bucket")
    open_members = members.where("NOT crowded").drop("crowded")
    unlike = open_members.where("NOT like").select("bucket", F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("root").alias("root_a"))
    open_ = unlike.join(open_members, "bucket").where("root <> root_a AND (like OR a < b)").where(near_in_length)
    wanted = open_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowd = cut(members.where("crowded").groupBy(F.col("b").alias("cid")).agg(F.first("n_b").alias("n"), F.first("root").alias("root"), F.bool_or(~F.col("like")).alias("open")))
    if not crowd.isEmpty():
        wanted = wanted.unionByName(crowded_pairs(crowd, held, similarity))
    pairs = cut(wanted.distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"))
    second = _compare(pairs, held, similarity)
    edges = first.where("ok").select("a", "b").unionByName(second.where("ok").select("a", "b"))
    roots = components(edges).select(F.col("node").alias("cid"), "root")
    drop(held)
    return texts.select("doc_id", "cid"), roots


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the group), group_size and keep of every row."""
    rows, roots = groups(docs, similarity)
    named = rows.join(roots, "cid", "left").select("doc_id", "cid", F.coalesce("root", "cid").alias("root"))
    w = Window.partitionBy("root")
    ranked = named.select(
        "doc_id",
        F.min("doc_id").over(w).alias("group_id"),
        F.count(F.lit(1)).over(w).alias("group_size"),
        (F.row_number().over(w.orderBy(F.col("doc_id").asc_nulls_last(), "cid")) == 1).alias("keep"),
    )
    bare = docs.where("text IS NULL").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return ranked.unionByName(bare)


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns as they are: one of each group of near copies, and those with NULL text."""
    rows, roots = groups(docs, similarity)
    # per content: how often it is there, and whether its group keeps it; contents without any copy need no decision
    contents = rows.groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.count(F.lit(1)).alias("times"))
    placed = contents.join(roots, "cid", "left").where("root IS NOT NULL OR times > 1").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct("least", "cid")).alias("best")).select(F.col("best.cid").alias("cid"), F.col("best.least.doc_id").alias("kept_id"))
    chosen = placed.select("cid").join(best.withColumn("best", F.lit(True)), "cid", "left").select("cid", F.coalesce("best", F.lit(False)).alias("best"), "kept_id")
    keyed = pack(docs, cid=content_id(docs["text"]), doc=docs["doc_id"])
    judged = keyed.join(chosen, "cid", "left")
    alone = judged.where("best IS NULL").select("row")
    ones = judged.where(F.col("best") & F.col("doc").eqNullSafe(F.col("kept_id"))).select("cid", "row")
    first = ones.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy(F.lit(1)))).where("k = 1").select("row")
    return alone.unionByName(first).select("row.*")
