"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (the character map, blanks to U+2581, a dummy prefix, blanks
squeezed, as the model says), the pieces (a trie whose final states emit a piece) and the byte fallback (a character
outside the vocabulary to its UTF-8 bytes). They are composed with an input as it is read, and the tropical-semiring
shortest path through the composition is the encoding. Weights: in a unigram model an arc costs minus the piece's
score. In a byte-pair model scores rank merges and don't add up, so a bigram acceptor stands in: two adjacent pieces
cost 0 if merging their joint characters gives those two pieces again, else infinity. A sequence is the byte-pair
encoding just if all its neighbours are such pairs, so that one path is finite. Runs of U+2581 overlap themselves, so
that their neighbours don't decide; they have a machine of their own, which reads a run once, from the left.

No piece holds U+2581 after another character, so an input is cut there and each distinct cut is composed once. A batch
whose texts have single blanks only, under a model that keeps them, goes through the normaliser's arcs by cutting at blanks.

Defined results: NULL gives NULL; an empty text, and one that normalises to nothing, gives no pieces. Decoding gives back the
normalised text but that U+2581 becomes a blank. Texts of any length, runs of any one character too, take time in proportion to it (a run of
blanks whose pieces rank apart: times its logarithm). Of equal paths the one whose last piece is longest is taken, and so on to the front, as the library
does. Every row has its own result, rows that repeat too; an empty table gives an empty one; columns but doc_id and text aren't read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ratemill.llm.common import chunks, in_arrow, recent, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = 4 << 20
#: Distinct cuts that a worker remembers in each of two generations.
REMEMBERED = 120_000
_END = ""
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _fields(b: bytes) -> Iterator[tuple]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = s = 0
        while True:
            x = b[i]
            i += 1
            n |= (x & 127) << s
            s += 7
            if x < 128:
                return n

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            v = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            v = b[i : i + n]
            i += n
        yield tag >> 3, v


def _character_map(blob: bytes) -> Iterator[tuple[str, str]]:
    """Keys and values of a compiled character map: a double-array trie of keys, then the values, each ended by a zero byte."""
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    values = blob[4 + size :]
    stack = [(0, b"")]
    while stack:
        at, key = stack.pop()
        u = units[at]
        base = at ^ ((u >> 10) << ((u & 512) >> 6))
        if key and u >> 8 & 1:
            begin = units[base] & 0x7FFFFFFF
            yield key.decode(), values[begin : values.index(b"\0", begin)].decode()
        for c in range(1, 256):
            if base ^ c < len(units) and units[base ^ c] & 0x800000FF == c:
                stack.append((base ^ c, key + bytes([c])))


class Normaliser:
    """A transducer over characters. Its states say what was written last: nothing, a blank, or else. An arc reads the longest
    key that fits, or one character if none does, and writes what that becomes; where blanks are squeezed, the arcs from
    the first two states write no blank at their beginning."""

    def __init__(self, keys: dict[str, str], dummy: bool, squeeze: bool, escape: bool):
        self.dummy, self.squeeze, self.blank = dummy, squeeze, BLANK if escape else " "
        self.plain = not keys
        self.arcs: dict = {}
        for key, value in keys.items():
            node = self.arcs
            for c in key:
                node = node.setdefault(c, {})
            node[_END] = value
        if not squeeze:
            self.arcs.setdefault(" ", {}).setdefault(_END, " ")
        self.special = re.compile("[" + "".join(map(re.escape, sorted({" ", *self.arcs}))) + "]")

    def run(self, text: str) -> str:
        out: list[str] = []
        special, arcs, squeeze, blank = self.special, self.arcs, self.squeeze, self.blank
        bare, began, i, n = squeeze, False, 0, len(text)
        while i < n:
            found = special.search(text, i)
            j = found.start() if found else n
            if j > i:  # a run of characters that stay as they are
                out.append(text[i:j])
                bare, began, i = False, True, j
                continue
            node, end, value = arcs.get(text[i]), i + 1, text[i]
            k = i + 1
            while node is not None:
                if _END in node:
                    end, value = k, node[_END]
                node, k = node.get(text[k]) if k < n else None, k + 1
            i = end
            began = began or not (squeeze and value == " ")
            if bare:
                value = value.lstrip(" ")
            if value:
                out.append(value.replace(" ", blank))
                bare = squeeze and value.endswith(" ")
        if not began:
            return ""
        whole = (blank if self.dummy else "") + "".join(out)
        return whole.rstrip(blank) if squeeze else whole


class Machine:
    """The compiled transducers of one model file."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.unigram, charmap, norm = True, b"", {}
        for k, v in _fields(raw):
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, 1))
            elif k == 2:
                self.unigram = dict(_fields(v)).get(3, 1) == 1
            elif k == 3:
                norm |= dict(_fields(v))
        charmap = norm.get(2, b"")
        own = {p: p for p, kind in zip(self.pieces, kinds) if kind == 4}  # the user's own symbols stay as they are
        self.dummy = bool(norm.get(3, 1))
        self.normaliser = Normaliser((dict(_character_map(charmap)) if charmap else {}) | own, self.dummy, bool(norm.get(4, 1)), bool(norm.get(5, 1)))
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind in (1, 4)}
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == 6}
        self.unknown = kinds.index(2)
        self.ends: dict = {}  # the pieces read backwards, from where they end
        for p, i in self.ids.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[_END] = i
        self.crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.pairs: dict[int, bool] = {}
        self.path_name = path
        blanks = {len(p): self.scores[i] for p, i in self.ids.items() if set(p) == {BLANK}}
        ranks = {v for k, v in blanks.items() if k > 1}
        self.alike = set(blanks) if len(ranks) <= 1 else None
        words = [self.scores[i] for p, i in self.ids.items() if p[0] == BLANK and p[-1] != BLANK]
        self.apart = 1 in blanks and (not ranks or max(ranks) < min(words, default=0.0))  # merges with a word come before those of a run
        shown = [p.replace(BLANK, " ").encode() if kind in (1, 4) else bytes([int(p[3:5], 16)]) if kind == 6 else b" \xe2\x81\x87 " if kind == 2 else b"" for p, kind in zip(self.pieces, kinds)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def merged(self, text: str) -> list[str]:
        """The byte-pair encoding of a text by its definition: the best-ranked pair first, the leftmost of equals."""
        ids, scores, n = self.ids, self.scores, len(text)
        parts: list = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-scores[i], k, text[k : k + 2]) for k in range(n - 1) if (i := ids.get(text[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or parts[k] + parts[j] != pair:
                continue  # one of them was merged since
            parts[k], parts[j] = pair, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (i := ids.get(both := parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (-scores[i], a, both))
        return [p for p in parts if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """The bigram acceptor: whether b may follow a."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            x, y = self.pieces[a], self.pieces[b]
            got = self.pairs[key] = self.merged(x + y) == [x, y]
        return got

    def paths(self, units: list[str]) -> Iterator[tuple[int, ...]]:
        """The shortest path through the composition of each normalised input with pieces and byte fallback. What was
        found for a prefix holds for every input that begins with it, so sorted inputs share that work."""
        past, cost, last, back = "", [0.0], [-1], [0]
        ends, unigram, scores, known = self.ends, self.unigram, self.scores, self.pairs
        for unit in units:
            if not unigram and unit.startswith(BLANK * 2):
                yield self._blanks(unit)
                continue
            n, at = len(unit), 0
            for at, (x, y) in enumerate(zip(past, unit)):
                if x != y:
                    break
            else:
                at = min(len(past), n)
            past = unit
            del cost[at + 1 :], last[at + 1 :], back[at + 1 :]
            for j in range(at, n):
                best, piece, begin = None, -1, 0
                node, i = ends, j
                while i >= 0:
                    node = node.get(unit[i])
                    if node is None:
                        break
                    p = node.get(_END)
                    if p is not None:
                        if unigram:
                            if best is None or cost[i] - scores[p] <= best:
                                best, piece, begin = cost[i] - scores[p], p, i
                        else:
                            a = last[i]
                            ok = True if a < 0 else known.get(a << 20 | p)
                            if ok is None:
                                ok = self.fits(a, p)
                            if ok:
                                best, piece, begin = cost[i], p, i
                                break
                    i -= 1
                if best is None:
                    best, piece, begin = cost[j] + 100.0, -2, j
                cost.append(best)
                last.append(piece)
                back.append(begin)
            out: list = []
            at = n
            while at:
                if last[at] == -2:
                    out += reversed(self._piece(unit[back[at] : at]))
                else:
                    out.append(last[at])
                at = back[at]
            yield tuple(out[::-1])

    def path(self, unit: str) -> tuple[int, ...]:
        return next(self.paths([unit]))

    def _blanks(self, unit: str) -> tuple[int, ...]:
        """A run of blanks before a word."""
        body = unit.lstrip(BLANK)
        if not self.apart:
            return tuple(x for p in self.merged(unit) for x in self._piece(p))
        run = len(unit) - len(body)
        head = self.path(BLANK + body) if body else ()
        joined = bool(head) and self.pieces[head[0]] != BLANK
        return (*self._run(run - joined), *(head if joined else head[1:]))

    def _run(self, n: int) -> list[int]:
        """The machine of a run of n blanks: where all its merges rank alike, the leftmost comes first, so what stands left of
        a blank is settled before it is read."""
        if self.alike is None:
            return [self.ids[p] for p in self.merged(BLANK * n)]
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-1] + sizes[-2] in self.alike:
                last = sizes.pop()
                sizes[-1] += last
        return [self.ids[BLANK * k] for k in sizes]

    def _piece(self, part: str) -> list[int]:
        if (i := self.ids.get(part)) is not None:
            return [i]
        return [self.byte[x] for x in part.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def normalise(self, text: str) -> str:
        return self.normaliser.run(text)

    def encode(self, text: str) -> list[int]:
        whole = self.normalise(text)
        units = [whole] if self.crossing and whole else _UNITS.findall(whole)
        found = dict(zip(some := sorted(set(units)), self.paths(some)))
        return [i for unit in units for i in found[unit]]

    def encode_batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts and the first of each; NULL counts as empty."""
        text = text.fill_null("") if text.null_count else text
        n = len(text)
        odd = np.asarray(pc.match_substring_regex(text, f"^$|^ |  | $|{BLANK}"), bool)
        if self.crossing or not self.normaliser.plain or self.normaliser.squeeze or not self.dummy:
            odd[:] = True
        lists = pc.split_pattern(text, " ")
        base = lists.offsets[0].as_py()
        at = np.asarray(lists.offsets) - base
        coded = lists.values.slice(base, at[-1]).dictionary_encode()
        ids = np.asarray(coded.indices)
        plain = ~odd
        seen = np.zeros(len(coded.dictionary), bool)
        seen[ids[np.repeat(plain, np.diff(at))]] = True
        units = [BLANK + w if s else "" for w, s in zip(coded.dictionary.to_pylist(), seen.tolist())]
        memory = recent(self.path_name, REMEMBERED)
        new = sorted(set(memory.missing([u for u in units if u])))
        known = memory.new
        known.update(zip(new, self.paths(new)))
        paths = [known[u] if u else () for u in units]
        sizes = np.array([len(p) for p in paths], np.int64)
        flat = np.fromiter((i for p in paths for i in p), np.int32, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        out, first = ragged(flat, starts, sizes, ids)
        first = first[at]
        if not odd.any():
            return out, first
        parts = [np.array(self.encode(text[i].as_py()), np.int32) if odd[i] else out[first[i] : first[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode_batch(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each begins."""
        sizes = np.diff(self.shown_at)
        data, at = ragged(self.shown, self.shown_at[:-1], sizes, ids)
        at = at[first]
        if not self.dummy:
            return data, at
        lead = (at[:-1] < at[1:]) & (data[np.minimum(at[:-1], max(len(data) - 1, 0))] == 32) if len(data) else np.zeros(len(at) - 1, bool)
        keep = np.ones(len(data), bool)
        keep[at[:-1][lead]] = False
        return data[keep], at - np.concatenate([[0], np.cumsum(lead)])

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs picks of values, one after the other, and where each begins."""
    n = sizes[picks]
    at = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    return values[np.repeat(starts[picks] - at[:-1], n) + np.arange(at[-1])], at


_MACHINES: dict[str, Machine] = {}


def machine(path: str = MODEL) -> Machine:
    if path not in _MACHINES:
        _MACHINES[path] = Machine(path)
    return _MACHINES[path]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip (whether decoding gives the text back) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                text = batch.column("text")
                none = np.asarray(text.is_null())
                ids, first = m.encode_batch(text)
                same = _equal(*m.decode_batch(ids, first), *text_bytes(text))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64(), mask=none), lists, pa.array(same, pa.bool_(), mask=none)], names=["doc_id", "n_pieces", "pieces", "round_trip"])

    slim = docs.select("doc_id", "text")
    ident = slim.schema["doc_id"].dataType.simpleString()
    return in_arrow(slim, run, f"doc_id {ident}, n_pieces bigint, pieces array<int>, round_trip boolean")


def _equal(data: np.ndarray, at: np.ndarray, want: np.ndarray, want_at: np.ndarray) -> np.ndarray:
    if np.array_equal(at, want_at):
        wrong = np.concatenate([[0], np.cumsum(data != want)])
        return np.diff(wrong[at]) == 0
    return np.array([data[a:b].tobytes() == want[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], want_at[:-1], want_at[1:])], bool)
