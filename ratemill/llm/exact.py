"""Exact dedup by Patricia tries.

Rows are partitioned by byte length and content hash. Each partition inserts its full byte strings into a
compressed radix trie, whose terminal nodes hold the smallest doc_id; a trie that outgrows its memory moves
its largest subtree to the shared folder and settles that subtree's rows at the end.

Defined results: a NULL text is no copy of anything and stays; empty texts are copies of each other; a NULL
doc_id comes after every other; of rows that repeat both text and doc_id one stays. Texts of any length are compared whole, byte
by byte. An empty table gives an empty one. dedup() gives back all columns of docs, whatever their names.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.llm.common import in_arrow, pack, shared_folder

#: Rows of one length and hash from which they are first compared in SALTS shares.
HOT_ROWS = 100_000
SALTS = 64
#: Bytes of labels that a trie holds before it spills a subtree.
TRIE_BYTES = 96 << 20


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    step = 16
    while a[:step] == b[:step]:
        lo, step = step, step * 2
    hi = min(hi, step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("label", "kids", "owner", "ends")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.ends = label, {}, None, False


class Spilled:
    """What stands for a subtree on disk: further rows of it are appended to its file."""

    __slots__ = ("path", "out")

    def __init__(self, files: pafs.FileSystem, path: str):
        self.path, self.out = path, files.open_output_stream(path)

    def add(self, record: tuple) -> None:
        pickle.dump(record, self.out)


class Trie:
    """put() gives (owner, first) of a string, or None where the string went to a spilled subtree."""

    def __init__(self, limit: int, spill: Callable[[], Spilled] | None):
        self.limit, self.spill, self.bytes, self.root = limit, spill, 0, Node(b"")

    def put(self, key: bytes, ident, payload) -> tuple | None:
        node, rest = self.root, key
        while True:
            if not rest:
                if node.ends:
                    return node.owner, False
                node.ends, node.owner = True, ident
                return ident, True
            kid = node.kids.get(rest[0])
            if kid is None:
                self._leaf(node, rest, ident)
                break
            if isinstance(kid, Spilled):
                kid.add((rest, ident, payload))
                return None
            n = len(kid.label)
            if rest[:n] == kid.label:
                node, rest = kid, rest[n:]
                continue
            m = common(kid.label, rest)
            fork = Node(kid.label[:m])
            kid.label = kid.label[m:]
            fork.kids[kid.label[0]] = kid
            node.kids[rest[0]] = fork
            node, rest = fork, rest[m:]
        if self.bytes > self.limit and self.spill:
            self._shed()
        return ident, True

    def _leaf(self, node: Node, rest: bytes, ident) -> None:
        leaf = Node(rest)
        leaf.ends, leaf.owner = True, ident
        node.kids[rest[0]] = leaf
        self.bytes += len(rest) + 200

    @staticmethod
    def _terminals(node: Node, before: bytes) -> Iterator[tuple]:
        stack = [(node, before)]
        while stack:
            at, so_far = stack.pop()
            so_far += at.label
            if at.ends:
                yield so_far, at.owner
            for kid in at.kids.values():
                stack.append((kid, so_far))

    @staticmethod
    def _whole(node: Node) -> bool:
        """Whether no part of the subtree is on disk."""
        stack = [node]
        while stack:
            for kid in stack.pop().kids.values():
                if isinstance(kid, Spilled):
                    return False
                stack.append(kid)
        return True

    def _shed(self) -> None:
        top = self.root
        while len(top.kids) == 1 and isinstance(only := next(iter(top.kids.values())), Node) and only.kids:
            top = only
        weights = {b: sum(len(k) + 200 for k, _ in self._terminals(kid, b"")) for b, kid in top.kids.items() if isinstance(kid, Node) and self._whole(kid)}
        if not weights or (len(top.kids) == 1 and not next(iter(top.kids.values())).kids):
            return
        b = max(weights, key=weights.get)
        stub = self.spill()
        for k, owner in self._terminals(top.kids[b], b""):
            stub.add((k, owner, None))
        top.kids[b] = stub
        self.bytes -= min(self.bytes, weights[b])

    def stubs(self) -> Iterator[Spilled]:
        stack = [self.root]
        while stack:
            for kid in stack.pop().kids.values():
                if isinstance(kid, Spilled):
                    yield kid
                else:
                    stack.append(kid)


def _owners(rows: Iterator[tuple], limit: int, folder: str) -> Iterator[tuple]:
    """(payload, owner, first) of each (key, ident, payload); rows come by ident."""
    state: dict = {}

    def spill() -> Spilled:
        if not state:
            state["fs"], state["at"] = pafs.FileSystem.from_uri(folder)  # the shared folder's full URI
            state["fs"].create_dir(state["at"], recursive=True)
        return Spilled(state["fs"], f"{state['at']}/trie-{uuid.uuid4().hex}")

    trie = Trie(limit, spill)
    for key, ident, payload in rows:
        got = trie.put(key, ident, payload)
        if got and payload is not None:
            yield payload, *got
    for stub in trie.stubs():
        stub.out.close()

        def again(path: str = stub.path) -> Iterator[tuple]:
            with state["fs"].open_input_stream(path) as f:
                while True:
                    try:
                        yield pickle.load(f)
                    except EOFError:
                        return

        yield from _owners(again(), limit, folder)
        state["fs"].delete_file(stub.path)


class _Row:
    """A row of a batch; pickled, a copy of that row alone."""

    __slots__ = ("batch", "at")

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.batch, self.at = batch, at

    def __reduce__(self):
        return _Row, (self.batch.take(pa.array([self.at])), 0)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        text = batch.column("row").field("text")
        for i, ident in enumerate(batch.column("doc").to_pylist()):
            yield text[i].as_buffer().to_pybytes(), ident, _Row(batch, i)


def _trie_pass(keyed: DataFrame, by: list[str], out: list[str], survivors: bool, trie_bytes: int, folder: str) -> DataFrame:
    """Columns out of keyed, with owner; only the first row of each text if survivors, else all and which is first."""
    kinds = {f.name: f.dataType for f in keyed.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in out], T.StructField("owner", kinds["doc"]), T.StructField("first", T.BooleanType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, picks, owners, firsts = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if picks:
                rows = held.select(out).take(pa.array(picks, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(owners, held.schema.field("doc").type), pa.array(firsts)], names=[*out, "owner", "first"])

        for row, owner, first in _owners(_read(batches), trie_bytes, folder):
            if survivors and not first:
                continue
            if row.batch is not held or len(picks) >= 2000:
                yield from flush()
                held, picks, owners, firsts = row.batch, [], [], []
            picks.append(row.at)
            owners.append(owner)
            firsts.append(first)
        yield from flush()

    return in_arrow(keyed.repartition(*by).sortWithinPartitions(F.col("doc").asc_nulls_last()), settle, schema)


def _keyed(docs: DataFrame, hot_rows: int) -> tuple[DataFrame, bool]:
    """row, doc, n, h and salt of the rows with text; whether any key is hot."""
    keys = docs.select(F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).where("n IS NOT NULL")
    hot = [tuple(r) for r in keys.groupBy("n", "h").count().where(F.col("count") > hot_rows).select("n", "h").collect()]
    keyed = pack(docs, doc=docs["doc_id"], n=F.octet_length("text"), h=F.xxhash64("text")).where("n IS NOT NULL")
    if not hot:
        return keyed.withColumn("salt", F.lit(0)), False
    # at most one key in hot_rows rows is hot; the optimizer broadcasts the list while it is small
    few = docs.sparkSession.createDataFrame(hot, "hot_n int, hot_h long").withColumn("is_hot", F.lit(True))
    joined = keyed.join(few, (F.col("n") == F.col("hot_n")) & (F.col("h") == F.col("hot_h")), "left")
    salt = F.when(F.col("is_hot"), 1 + F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(SALTS))).otherwise(0).cast("int")
    return joined.select("row", "doc", "n", "h", salt.alias("salt")), True


def owners(docs: DataFrame, hot_rows: int = HOT_ROWS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, n_bytes, owner_id (smallest doc_id of that text) and keep (one row of each text) of every row."""
    folder = shared_folder(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    keyed, hot = _keyed(slim, hot_rows)
    one = _trie_pass(keyed, ["n", "h", "salt"], ["doc", "n", "h", "salt", "row"] if hot else ["doc", "n"], False, trie_bytes, folder)
    if hot:
        local = one.where("salt > 0 AND first").select("row", "doc", "n", "h")
        two = _trie_pass(local, ["n", "h"], ["n", "h", "doc"], False, trie_bytes, folder).select("n", "h", F.col("doc").alias("local"), F.col("owner").alias("whole"), F.col("first").alias("lead"))
        # a partition's trie may serve several shares, so a row finds the whole group's owner by its local one
        one = one.alias("a").join(two.alias("b"), (F.col("a.n") == F.col("b.n")) & (F.col("a.h") == F.col("b.h")) & F.col("a.owner").eqNullSafe(F.col("b.local")), "left").select("a.doc", "a.n", F.when(F.col("a.salt") > 0, F.col("whole")).otherwise(F.col("a.owner")).alias("owner"), F.when(F.col("a.salt") > 0, F.col("a.first") & F.col("lead")).otherwise(F.col("a.first")).alias("first"))
    bare = slim.where("text IS NULL").select("doc_id", F.lit(None).cast("int").alias("n_bytes"), F.col("doc_id").alias("owner_id"), F.lit(True).alias("keep"))
    return one.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_bytes"), F.col("owner").alias("owner_id"), F.col("first").alias("keep")).unionByName(bare)


def dedup(docs: DataFrame, hot_rows: int = HOT_ROWS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, less those that repeat the text of a smaller doc_id."""
    folder = shared_folder(docs.sparkSession)
    keyed, hot = _keyed(docs, hot_rows)
    keep = ["row", "doc", "n", "h", "salt"] if hot else ["row"]
    one = _trie_pass(keyed, ["n", "h", "salt"], keep, True, trie_bytes, folder)
    kept = one.select("row")
    if hot:
        merged = _trie_pass(one.where("salt > 0").drop("owner", "first"), ["n", "h"], ["row"], True, trie_bytes, folder)
        kept = one.where("salt = 0").select("row").unionByName(merged.select("row"))
    return kept.unionByName(pack(docs).where("row.text IS NULL")).select("row.*")
