"""Suffix-array dedup: passages of LENGTH or more words that occur more than once.

Every window of LENGTH words goes to the smallest hash among its runs of ANCHOR words, so equal windows, wherever they
are, meet under one anchor; neighbouring windows of one anchor travel as one segment. Anchors that occur once are
dropped before any text moves, and equal segments are folded. Over the segments of its anchors a task builds a
Burrows-Wheeler transform and expands intervals breadth-first by backward extension, which finds the common prefixes of
neighbouring suffixes by increasing length; it stops at LENGTH, and the pairs that are left have at least that. All
windows are treated: the anchors only say where each is compared. Anchors with more occurrences than a task can hold have
their windows compared one by one, by hash.

Words are what white space (ASCII) parts; how much white space parts them doesn't matter. Repeats within a document count too.

Exactness: all windows are compared; equal words, segments and windows are told by hashes, of 64 bits for words (all LENGTH of a
window have to agree), of 128 for segments and for windows of hot anchors.

Defined results: NULL and empty texts, and those of fewer than LENGTH words, have no passages; rows equal in doc_id and
text repeat each other and are reported once; a NULL doc_id is reported as NULL. A text of any length is cut up whole; passages of equal
texts are reported for each. An empty table gives an empty one. Columns but doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratemill.llm.common import chunks, content_id, drop, in_arrow, mix, offsets, span_hashes, spans, text_bytes, white, written

LENGTH = 50
ANCHOR = 12
#: Bytes of segments that are put into one transform; the segments of an anchor are never parted.
BLOCK = 1 << 20
#: Bytes of segments from which an anchor is too much for one task (a transform takes some thirty times its text). Its windows are compared by 128-bit hashes instead, each where its own hash sends it.
HOT_BYTES = 4 << 20


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _slide(x: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    """pick over every span neighbours."""
    wide = 1
    while wide < span:
        step = min(wide, span - wide)
        x = pick(x[:-step], x[step:])
        wide += step
    return x


def segments(col: pa.Array, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of all segments: anchor, first byte, end, how often the anchor is in it; and the first segment of each text."""
    data, at = text_bytes(col)
    starts, ends, first = spans(white(data), at)
    n = len(starts)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(len(at), np.int64)
    words = span_hashes(data, starts, ends)
    grams = words[: n - anchor + 1].copy()
    for j in range(1, anchor):
        grams = grams * np.uint64(0x100000001B3) + words[j : n - anchor + 1 + j]
    grams = mix(grams)
    span = length - anchor + 1
    low = _slide(grams, span, np.minimum)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    begin, every = np.arange(len(low)), low
    fits = begin + length <= first[1:][doc[: len(low)]]
    begin, low = begin[fits], low[fits]
    if not len(begin):
        return none, none, none, none, np.zeros(len(at), np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (low[1:] != low[:-1]) | (begin[1:] != begin[:-1] + 1) | (doc[begin[1:]] != doc[begin[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(begin)) - 1
    base = at[:-1][doc[begin[head]]]
    rows = np.searchsorted(doc[begin[head]], np.arange(len(at)))
    # a position is an anchor if it has the smallest hash of some window
    edge = np.zeros(span - 1, np.uint64)
    places = np.flatnonzero(grams == _slide(np.concatenate([edge, every, edge]), span, np.maximum))
    kinds, which = np.unique(grams[places], return_inverse=True)
    keys = np.sort(which * np.int64(n) + places)
    mine = np.searchsorted(kinds, low[head]) * np.int64(n)
    times = np.searchsorted(keys, mine + begin[tail] + span) - np.searchsorted(keys, mine + begin[head])
    return low[head].view(np.int64), starts[begin[head]] - base, ends[begin[tail] + length - 1] - base, times, rows


def repeated(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each position of symbols, whether the length symbols from there occur elsewhere too. Separators are symbols that occur once."""
    n = len(symbols)
    # suffixes ordered by their first symbols, as many as a power of two from length on: enough for strings up to length
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    known = 1
    while True:
        sorted_ = rank[order]
        dense = np.zeros(n, np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        if known > length or dense[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - known] = dense[known:] + 1
        rank = dense * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        known *= 2
    bwt = symbols[order - 1]
    back = np.empty(n, np.int64)  # the last-to-first mapping
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    run = np.zeros(n, np.int64)
    np.cumsum(bwt[1:] != bwt[:-1], out=run[1:])
    settled = np.zeros(n + 1, bool)  # whether the common prefix of suffix i with the one before is known
    settled[0] = settled[n] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(length):
        alike = run[left] == run[right - 1]
        lo = back[left[alike]]
        hi = lo + (right - left)[alike]
        a, b = left[~alike], right[~alike]
        if len(a):
            size = b - a
            idx = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            owner = np.repeat(np.arange(len(a)), size)
            # LF keeps the order of equal symbols: an interval's occurrences of one are adjacent there
            target = back[idx]
            by = np.lexsort((target, owner))
            t, o, s = target[by], owner[by], bwt[idx[by]]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(fresh)
            lo = np.concatenate([lo, t[at]])
            hi = np.concatenate([hi, t[at] + np.diff(np.append(at, len(t)))])
        open_ = ~settled[hi]
        left, right = lo[open_], hi[open_]
        right, once = np.unique(right, return_index=True)
        left = left[once]
        settled[right] = True
        if not len(left):
            break
    long_ = ~settled
    out = np.zeros(n, bool)
    out[order] = long_[:-1] | long_[1:]
    return out


def _expand(segs: pa.Array, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of the repeated passages of each segment, and the first of each."""
    data, at = text_bytes(segs)
    starts, ends, first = spans(white(data), at)
    n_words = np.diff(first)
    _, ids = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    top = int(ids.max()) + 1 if len(ids) else 1
    seg = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(ids)) + seg
    symbols = np.empty(len(ids) + len(n_words), np.int64)
    symbols[place] = ids
    symbols[first[1:] + np.arange(len(n_words))] = top + np.arange(len(n_words))
    begins = repeated(symbols, length)[place]
    begins |= times[seg] > 1
    begins &= np.arange(len(ids)) + length <= first[1:][seg]
    # windows that overlap are one passage
    begin = np.flatnonzero(begins)
    if not len(begin):
        return begin, begin, np.zeros(len(n_words) + 1, np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (seg[begin[1:]] != seg[begin[:-1]]) | (begin[1:] >= begin[:-1] + length)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(begin)) - 1
    owner = seg[begin[head]]
    return starts[begin[head]] - at[owner], ends[begin[tail] + length - 1] - at[owner], np.searchsorted(owner, np.arange(len(n_words) + 1))


def _windows(segs: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Of all windows: the segment, first byte, end and two hashes."""
    data, at = text_bytes(segs)
    starts, ends, first = spans(white(data), at)
    seg = np.repeat(np.arange(len(segs)), np.diff(first))
    words = span_hashes(data, starts, ends)
    begin = np.arange(len(words))
    begin = begin[begin + length <= first[1:][seg]]
    one, two = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for j in range(length):
        one = mix(one + words[begin + j])
        two = two * np.uint64(0x9E3779B97F4A7C15) + mix(words[begin + j] ^ np.uint64(0xD6E8FEB86659FD93))
    return seg[begin], starts[begin] - at[seg[begin]], ends[begin + length - 1] - at[seg[begin]], one.view(np.int64), mix(two).view(np.int64)


def passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, first_byte and end_byte of every maximal passage all of whose windows of length words occur elsewhere too."""
    anchor = min(anchor, length)
    slim = docs.select("doc_id", F.col("text"), content_id(F.col("text")).alias("cid")).where("text IS NOT NULL")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                hashes, a, b, times, first = segments(batch.column("text"), length, anchor)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cid"), _lists(first, hashes, pa.int64()), _lists(first, a, pa.int32()), _lists(first, b, pa.int32()), _lists(first, times, pa.int32())], names=["doc_id", "cid", "h", "a", "b", "times"])

    ident = slim.schema["doc_id"].dataType.simpleString()
    cells = written(in_arrow(slim, cut_up, f"doc_id {ident}, cid binary, h array<bigint>, a array<int>, b array<int>, times array<int>").select("doc_id", "cid", F.inline(F.arrays_zip("h", "a", "b", "times"))))
    shared = cells.groupBy("h").agg(F.sum("times").alias("n"), F.sum(F.col("b") - F.col("a")).alias("size")).where("n > 1").select("h", (F.col("size") > hot_bytes).alias("hot"))
    wanted = cells.join(shared, "h").groupBy("doc_id", "cid").agg(F.collect_list(F.struct("h", "hot", "a", "b")).alias("parts"))
    d, w = slim.alias("d"), wanted.alias("w")
    taken = d.join(w, F.col("d.cid").eqNullSafe(F.col("w.cid")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "d.cid", F.col("d.text").cast("binary").alias("bytes"), "parts")
    segs = written(taken.select("doc_id", "cid", F.inline(F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["hot"].alias("hot"), p["a"].alias("a"), F.substring("bytes", p["a"] + 1, p["b"] - p["a"]).alias("seg"))))))
    drop(cells)
    folded = segs.groupBy("h", "hot", "seg").agg(F.count(F.lit(1)).alias("n"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, block):
            seg = batch.column("seg")
            a, b, first = _expand(seg, np.asarray(batch.column("n")), length)
            out = pa.RecordBatch.from_arrays([batch.column("h"), seg, _lists(first, a, pa.int32()), _lists(first, b, pa.int32())], names=["h", "seg", "from", "to"])
            yield out.filter(pa.array(np.diff(first) > 0))

    few = folded.where("NOT hot").select("h", "seg", "n")
    found = in_arrow(few.repartition("h").sortWithinPartitions("h"), transform, "h bigint, seg binary, from array<int>, to array<int>").select("h", content_id(F.col("seg")).alias("sid"), "from", "to")

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole.set_column(1, "seg", whole.column("seg").cast(pa.large_binary())), "seg"):
                row, a, b, one, two = _windows(batch.column("seg"), length)
                some = batch.select(["h", "sid", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(one), pa.array(two)], names=["h", "sid", "n", "from", "to", "one", "two"])

    many = in_arrow(folded.where("hot").select("h", "seg", content_id(F.col("seg")).alias("sid"), "n"), each_window, "h bigint, sid binary, n bigint, from int, to int, one bigint, two bigint")
    twice = many.groupBy("one", "two").agg(F.sum("n").alias("all")).where("all > 1").select("one", "two")
    found = found.unionByName(many.join(twice, ["one", "two"]).groupBy("h", "sid").agg(F.collect_list(F.struct("from", "to")).alias("w")).select("h", "sid", F.col("w.from").alias("from"), F.col("w.to").alias("to")))
    placed = segs.select("doc_id", "cid", "h", "a", content_id(F.col("seg")).alias("sid")).join(found, ["h", "sid"])
    spots = placed.select("doc_id", "cid", "a", F.inline(F.arrays_zip("from", "to"))).select("doc_id", "cid", (F.col("a") + F.col("from")).alias("first_byte"), (F.col("a") + F.col("to")).alias("end_byte"))
    order = Window.partitionBy("doc_id", "cid").orderBy("first_byte", "end_byte")
    reach = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # passages that only touch stay apart
    marked = spots.withColumn("new", F.coalesce((F.col("first_byte") >= reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "cid", "k").agg(F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte")).select("doc_id", "first_byte", "end_byte")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut so that each has whole anchors and about block bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        batch = batch.set_column(batch.schema.get_field_index("seg"), "seg", batch.column("seg").cast(pa.large_binary()))
        for part in chunks(batch, "seg", block):
            held.append(part)
            size += int(np.diff(offsets(part.column("seg"))[[0, -1]])[0])
            h = np.asarray(part.column("h"))
            if size < block or len(held) > 1 and h[-1] == held[0].column("h")[0].as_py():
                continue  # too little, or one anchor still
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = np.asarray(joined.column("h"))
            end = int(np.searchsorted(h, h[-1])) if h[0] != h[-1] else 0
            if end:
                yield joined.slice(0, end)
                held = [joined.slice(end)]
                size = int(np.diff(offsets(held[0].column("seg"))[[0, -1]])[0])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
