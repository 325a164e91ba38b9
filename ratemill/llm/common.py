"""Shared pieces: the shared folder, vectorised views of Arrow text, hashing.

Texts are handled as whole byte buffers: a batch of documents is one uint8 array, and words, their
hashes and their k-grams are computed for all of its documents at once.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.session import bound_batches, remove, shared_folder

#: Bytes of text that are turned into numpy arrays at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes whose running hash is held at once, however long a document is.
HASH_BYTES = 1 << 18

MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; what follows is recovered from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(each, schema) with batches of bounded bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(each, schema)


def content_id(text: Column) -> Column:
    """16 bytes that stand for a text; NULL for NULL."""
    return F.unhex(F.md5(text.cast("binary")))


def pack(docs: DataFrame, **extra: Column) -> DataFrame:
    """Every column of docs in one struct, so that columns made here can't clash with its own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in extra.items()])


def unpack(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about limit bytes together."""
    sizes = np.diff(offsets(batch.column(column)))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def offsets(col: pa.Array) -> np.ndarray:
    """Where each text begins, and the last ends, in the column's bytes."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; NULL counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    at = offsets(col)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def spans(keep: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes within rows: their starts and ends, and the first run of each row."""
    n = len(keep)
    cutting = np.zeros(n + 1, bool)
    cutting[at] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, ~keep[:-1]
        after[-1], after[:-1] = True, ~keep[1:]
        before |= cutting[:n]
        after |= cutting[1:]
    starts = np.flatnonzero(keep & before)
    return starts, np.flatnonzero(keep & after) + 1, np.searchsorted(starts, at)


_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for b in (_BASE, _INVERSE):
            p = np.full(HASH_BYTES, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on nothing else. Spans are in order, not empty and don't overlap."""
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    for p in range(0, len(data), HASH_BYTES):
        q = min(p + HASH_BYTES, len(data))
        i, j = np.searchsorted(ends, p, "right"), np.searchsorted(starts, q, "left")
        if i == j:
            continue
        sums = np.zeros(q - p + 1, np.uint64)
        np.cumsum((data[p:q].astype(np.uint64) + np.uint64(1)) * up[: q - p], out=sums[1:])
        a, b = np.maximum(starts[i:j], p) - p, np.minimum(ends[i:j], q) - p
        part = (sums[b] - sums[a]) * down[a]
        if starts[i] < p:  # it began in an earlier piece
            part[:1] *= np.uint64(pow(int(_BASE), int(p - starts[i]), 1 << 64))
        out[i:j] += part
    return mix(out + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def white(data: np.ndarray) -> np.ndarray:
    """Where bytes are not white space: ASCII blanks and controls part words, nothing else does."""
    return data > 32


def seeded(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


class Recent:
    """What a worker has found for strings lately: two generations, so that what is used stays."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Those of keys for which nothing is known; all others can be read until the next call."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    new[k] = v
        return out


_RECENT: dict[str, Recent] = {}


def recent(name: str, size: int) -> Recent:
    """The memory of that name; a worker keeps one at a time."""
    if name not in _RECENT:
        _RECENT.clear()
        _RECENT[name] = Recent(size)
    return _RECENT[name]


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as a compressed table to the shared folder and read from there; removed by drop(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(_drop_all)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = out, path
    return out


def drop(df: DataFrame) -> None:
    """Removes the table of a DataFrame that written() gave, which nothing that is still to run may read."""
    remove(df.sparkSession, _WRITTEN.pop(id(df))[1])


def _drop_all() -> None:
    for df, _ in list(_WRITTEN.values()):
        drop(df)
