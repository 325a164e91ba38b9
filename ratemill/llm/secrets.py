"""Secret scans by a linear-chain conditional random field.

Tokens are runs of letters, digits and - _ + / . ~ $; each is tagged as beginning a secret, inside one, or outside. Features
are a token's shape (length, digits, capitals, changes of class, distinct bytes, first bytes), the bytes around it, the
words before and after it, and what the file is like (how many digits it has, how long it is). Tags are decoded by Viterbi over
the whole text; an inside tag only follows a begin or an inside tag. A text none of whose tokens comes near a secret
is known to be all outside without decoding, by a bound on what transitions can add.

The field is fitted in numpy by maximum conditional likelihood to windows of at most SAMPLE rows (smallest seeded hash of
doc_id), into half of which invented secrets of many formats are put; windows that have a known format already are left out.

Defined results: NULL and empty texts have no secrets; rows that repeat have theirs each; a NULL doc_id is reported as NULL. Texts of
any length are decoded whole. Of equally good paths the one with the earlier tag (begin, inside, outside) is taken, from the end on. An
empty table gives an empty one. Columns but doc_id and text aren't read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm.common import chunks, in_arrow, mix, span_hashes, spans, text_bytes

SAMPLE = 400
SEED = 31
WINDOW = 40
WINDOWS_PER_ROW = 6
EPOCHS = 35
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
_NEVER = -1e4
CHUNK = 8 << 20

_CLASS = np.zeros(256, np.uint8)  # 0 none, 1 lower, 2 upper, 3 digit, 4 mark, 5 beyond ASCII
for _a, _b, _c in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (128, 256, 5)):
    _CLASS[_a:_b] = _c
for _x in b"-_+/.~$":
    _CLASS[_x] = 4
_PART = _CLASS > 0
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = _HEX[65:71] = True

#: Sizes of the feature families.
_WIDTHS = {"length": 12, "digits": 6, "capitals": 6, "changes": 10, "kinds": 32, "hex": 12, "head": 512, "before": 128, "after": 128, "last": 1024, "next": 1024, "file_digits": 6, "file_length": 6, "digits_by_length": 72, "changes_by_length": 120, "last_by_length": 4096}
_BASE = dict(zip(_WIDTHS, np.concatenate([[0], np.cumsum(list(_WIDTHS.values()))[:-1]]).tolist()))
N_FEATURES = sum(_WIDTHS.values())


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, 5 for all, in between by fifths."""
    return np.where(part == 0, 0, np.where(part == whole, 5, 1 + (part * 4 // np.maximum(whole, 1)))).astype(np.int64)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of every token, its first byte and end, and the first token of each text."""
    data, at = text_bytes(col)
    kind = _CLASS[data]
    starts, ends, first = spans(_PART[data], at)
    n = len(starts)
    if not n:
        return np.zeros((0, len(_WIDTHS)), np.int32), starts, ends, first
    size = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.int64)

    digits, capitals, hexes = count(kind == 3), count(kind == 2), count(_HEX[data])
    change = np.zeros(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts] = False
    changes = count(change)
    distinct = np.zeros(n, np.int64)  # 5-bit classes of bytes that occur
    bits = np.bitwise_or.reduceat(np.uint32(1) << (data & 31).astype(np.uint32), starts) if n else distinct
    # reduceat runs to the next start, so marks between tokens may count; they're the same few
    for _ in range(32):
        distinct += bits & 1
        bits = bits >> np.uint32(1)
    length = np.digitize(size, (2, 4, 6, 8, 11, 14, 18, 24, 33, 41, 65))
    words = span_hashes(data, starts, ends)
    head = span_hashes(data, starts, np.minimum(starts + 4, ends))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    before = np.where(starts > at[:-1][doc], data[np.maximum(starts - 1, 0)], 0)
    after = np.where(ends < at[1:][doc], data[np.minimum(ends, len(data) - 1)], 0)
    prev_, next_ = np.full(n, 1, np.uint64), np.full(n, 1, np.uint64)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    prev_[inner] = words[np.flatnonzero(inner) - 1]
    next_[np.flatnonzero(inner) - 1] = words[inner]
    file_digits = np.add.reduceat(np.append(digits, 0), np.minimum(first[:-1], n)) * (np.diff(first) > 0)
    long_ = np.digitize(np.diff(at), (100, 1_000, 10_000, 100_000, 1_000_000))
    last = (prev_ >> np.uint64(54)).astype(np.int64)
    d5 = _share(digits, size)
    parts = {
        "length": length, "digits": d5, "capitals": _share(capitals, size), "changes": np.minimum(changes, 9), "kinds": np.minimum(distinct, 31), "hex": np.where(hexes == size, length, 0),
        "head": (head >> np.uint64(55)).astype(np.int64), "before": before & 127, "after": after & 127, "last": last, "next": (next_ >> np.uint64(54)).astype(np.int64),
        "file_digits": np.digitize(file_digits, (1, 10, 50, 200, 1000))[doc], "file_length": long_[doc], "digits_by_length": d5 * 12 + length, "changes_by_length": np.minimum(changes, 9) * 12 + length,
        "last_by_length": (mix(prev_ + (length // 3).astype(np.uint64)) >> np.uint64(52)).astype(np.int64),
    }
    ids = np.empty((n, len(_WIDTHS)), np.int32)
    for k, (name, value) in enumerate(parts.items()):
        ids[:, k] = value.astype(np.int32) + _BASE[name]
    return ids, starts, ends, first


@dataclass
class Field:
    weights: np.ndarray  # (N_FEATURES, 3)
    moves: np.ndarray  # (3, 3): from, to
    start: np.ndarray

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = self.weights[ids[:, 0]].copy()
        for k in range(1, ids.shape[1]):
            out += self.weights[ids[:, k]]
        return out

    def decode(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of all texts."""
        tags = np.full(len(emit), OUTSIDE, np.int8)
        allowed = self.moves[self.moves > _NEVER / 2]
        bound = 2 * float(max(allowed.max(), self.start.max(), 0) - min(allowed.min(), self.start[[BEGIN, OUTSIDE]].min(), 0))
        near = np.flatnonzero(emit[:, :2].max(1) - emit[:, 2] >= -bound)
        some = np.unique(np.searchsorted(first, near, side="right") - 1)
        some = some[np.argsort(first[some] - first[some + 1], kind="stable")]  # the longest first
        size = first[some + 1] - first[some]
        at = 0
        while at < len(some):  # texts of about one length at a time, so that what is held for the way back is in proportion to them
            end = int(np.searchsorted(-size, -(size[at] // 2), side="left"))
            end = max(end, at + 1)
            self._best(emit, first[some[at:end]], size[at:end], tags)
            at = end
        return tags

    def _best(self, emit: np.ndarray, begin: np.ndarray, size: np.ndarray, tags: np.ndarray) -> None:
        back = np.empty((len(begin), int(size[0]), 3), np.int8)
        score = self.start + emit[begin]
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))  # texts that have a token t
            ways = score[:live, :, None] + self.moves
            best = ways.argmax(1)
            back[:live, t] = best
            score[:live] = ways.max(1) + emit[begin[:live] + t]
        tag = score.argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            tags[begin[:live] + t] = tag[:live]
            if t:
                tag[:live] = back[np.arange(live), t, tag[:live]]


def _secret(r: random.Random) -> tuple[str, int, int]:
    """An invented secret with its surroundings, and where in that it is."""
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, wide = "0123456789abcdef", low + up + dig
    bare = [
        lambda: pick("AAA", 1) + "KIA" + pick(up + dig, 16), lambda: "ASIA" + pick(up + dig, 16), lambda: "ghp_" + pick(wide, 36), lambda: "sk-" + pick(wide, 48), lambda: "xoxb-" + pick(dig, 11) + "-" + pick(wide, 24),
        lambda: "AIza" + pick(wide + "-_", 35), lambda: "glpat-" + pick(wide, 20), lambda: "sk_live_" + pick(wide, 24), lambda: "eyJ" + pick(wide, 20) + "." + pick(wide, 40) + "." + pick(wide + "-_", 43),
    ]
    keyed = [lambda: pick(hexes, r.choice((16, 18, 20, 24, 32, 40, 64))), lambda: pick(wide, r.randrange(16, 44)), lambda: pick(wide + "+/", 40), lambda: pick(low + dig, r.randrange(10, 24))]
    if r.random() < 0.4:
        value = r.choice(bare)()
        lead, tail = r.choice((("", ""), ("", "."), ("key: ", ""), ('"', '"'), ("AWS_ACCESS_KEY_ID=", ""), ("token ", ""))) if r.random() < 0.5 else ("", "")
    elif r.random() < 0.1:
        value = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(wide + "+/", 64) for _ in range(r.randrange(2, 6))) + "\n-----END RSA PRIVATE KEY-----"
        lead = tail = ""
    else:
        value = r.choice(keyed)()
        name = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_token", "auth_token", "client_secret", "secret_key", "aws_secret_access_key", "private_key"))
        name = r.choice((name, name.upper(), name))
        lead, tail = r.choice(((f"{name}=", ""), (f'{name} = "', '"'), (f"{name}: ", ""), (f"{name}='", "'"), (f'"{name}": "', '"'), (f"{name} = ", ""), (f"{name} := ", "")))
    return lead + value + tail, len(lead), len(lead) + len(value)


def _decoy(r: random.Random) -> str:
    """Something that looks alike and is none."""
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice((
        lambda: dig(16), lambda: f"({dig(3)}) {dig(3)}-{dig(4)}", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: f"20{dig(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}",
        lambda: f"v{r.randrange(9)}.{r.randrange(20)}.{r.randrange(20)}", lambda: f"name.{dig(2)}@mail{dig(1)}.example.com", lambda: f"https://www.example.com/en/{dig(4)}?page=2", lambda: r.choice(("token", "password", "secret", "api_key", "the password is lost", "token ring")),
        lambda: f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}", lambda: f"+{dig(2)} {dig(3)} {dig(7)}", lambda: f"$ {dig(3)},{dig(3)}.{dig(2)}", lambda: f"ISBN {dig(13)}", lambda: r.choice(("NASA", "UTF-8", "HTTP/1.1", "COVID-19", "McDonald", "iPhone15", "Windows10")),
    ))()


_KNOWN = re.compile(r"(?i)(?:passw|pwd|secret|token|api.?key|private key|akia|asia[A-Z0-9]{8}|ghp_|sk-|xox|eyJ|glpat|aiza)|[0-9a-f]{16,}|(?=\S*[A-Z])(?=\S*[0-9])(?=\S*[a-z])\S{20,}")


def examples(texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (windows, WINDOW, families), tags and lengths of windows with and without secrets."""
    r = random.Random(seed)
    made, spots = [], []
    for text in texts:
        words = text.split(" ")
        for _ in range(WINDOWS_PER_ROW):
            n = min(len(words), r.randrange(1, WINDOW))
            at = r.randrange(len(words) - n + 1)
            some = words[at : at + n]
            if _KNOWN.search(" ".join(some)):
                continue
            marks = []
            if r.random() < 0.3:
                some.insert(r.randrange(len(some) + 1), _decoy(r))
            if r.random() < 0.5:
                value, a, b = _secret(r)
                k = r.randrange(len(some) + 1)
                base = len(" ".join(some[:k]).encode()) + (1 if k else 0)
                some.insert(k, value)
                marks = [(base + a, base + b)]
            made.append(" ".join(some))
            spots.append(marks)
    ids, starts, ends, first = tokens(pa.array(made, pa.string()))
    offset = np.concatenate([[0], np.cumsum([len(m.encode()) for m in made])])
    x = np.zeros((len(made), WINDOW + 30, ids.shape[1]), np.int32)
    y = np.full(x.shape[:2], OUTSIDE, np.int8)
    size = np.minimum(np.diff(first), x.shape[1]) if len(made) else np.zeros(0, np.int64)
    for i, marks in enumerate(spots):
        n = size[i]
        x[i, :n] = ids[first[i] : first[i] + n]
        for a, b in marks:
            s = starts[first[i] : first[i] + n] - offset[i]
            e = ends[first[i] : first[i] + n] - offset[i]
            inside = np.flatnonzero((s < b) & (e > a))
            y[i, inside] = INSIDE
            y[i, inside[:1]] = BEGIN
    return x[size > 0], y[size > 0], size[size > 0]


def fit(texts: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Field:
    x, y, size = examples(texts, seed)
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    field.moves[OUTSIDE, INSIDE] = field.start[INSIDE] = _NEVER
    if not len(x):
        field.weights[:, OUTSIDE] = 100.0
        return field
    real = np.arange(x.shape[1]) < size[:, None]
    hot = np.eye(3)[y] * real[..., None]
    sw, sm, ss = (np.full(a.shape, 1e-2) for a in (field.weights, field.moves, field.start))
    for epoch in range(epochs):
        _, gw, gm, gs = gradient(field, x, hot, real)
        gw -= 2e-1 * field.weights
        gm -= 0.2 * np.where(field.moves > _NEVER / 2, field.moves, 0)
        gm[OUTSIDE, INSIDE] = gs[INSIDE] = 0
        for p, s, g in ((field.weights, sw, gw), (field.moves, sm, gm), (field.start, ss, gs)):
            s += g * g
            p += 0.5 * g / np.sqrt(s)
    field.weights = field.weights.astype(np.float32)
    return field


def gradient(field: Field, x: np.ndarray, hot: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The conditional log-likelihood of the tags hot (one-hot, zero beyond a window's end) and its gradient by weights, moves
    and start, by the forward-backward algorithm. The first token of every window is real."""
    n, t, k = x.shape
    flat = x.reshape(-1, k)
    emit = field.emissions(flat).reshape(n, t, 3)
    alpha = np.empty((n, t, 3))
    alpha[:, 0] = field.start + emit[:, 0]
    for i in range(1, t):
        step = _lse(alpha[:, i - 1, :, None] + field.moves, 1) + emit[:, i]
        alpha[:, i] = np.where(real[:, i, None], step, alpha[:, i - 1])
    total = _lse(alpha[:, -1], 1)
    beta = np.zeros((n, t, 3))
    pairs = np.zeros((3, 3))
    for i in range(t - 2, -1, -1):
        ahead = field.moves + (emit[:, i + 1] + beta[:, i + 1])[:, None]
        beta[:, i] = np.where(real[:, i + 1, None], _lse(ahead, 2), 0.0)
        joint = np.exp(alpha[:, i, :, None] + ahead - total[:, None, None])
        pairs += (joint * real[:, i + 1, None, None]).sum(0)
    post = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
    diff = (hot - post).reshape(-1, 3)
    gw = np.zeros(field.weights.shape)
    for f in range(k):
        for c in range(3):
            gw[:, c] += np.bincount(flat[:, f], weights=diff[:, c], minlength=len(gw))
    gold = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    told = float((hot * emit).sum() + (gold * field.moves).sum() + (hot[:, 0] @ field.start).sum() - total.sum())
    return told, gw, gold - pairs, hot[:, 0].sum(0) - post[:, 0].sum(0)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def model(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Field:
    known = docs.where("text IS NOT NULL AND doc_id IS NOT NULL")
    some = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    rows = known.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect()
    return fit([r.text for r in rows], seed)


def find(col: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte and end of every secret."""
    ids, starts, ends, first = tokens(col)
    if not len(ids):
        return starts, starts, starts
    _, at = text_bytes(col)
    tags = field.decode(field.emissions(ids), first)
    head = np.flatnonzero(tags == BEGIN)
    doc = np.searchsorted(first, head, side="right") - 1
    stop = np.flatnonzero(np.append(tags != INSIDE, True))
    tail = stop[np.searchsorted(stop, head + 1)] - 1
    tail = np.minimum(tail, first[doc + 1] - 1)
    return doc, starts[head] - at[doc], ends[tail] - at[doc]


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, first_byte, end_byte and masked (its first bytes, the rest hidden) of every secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK):
                text = batch.column("text")
                doc, a, b = find(text, field)
                raw = [text[i].as_buffer().to_pybytes()[s:e] for i, s, e in zip(doc.tolist(), a.tolist(), b.tolist())]
                masked = [v[:4].decode("utf-8", "ignore") + "*" * max(0, len(v) - 4) for v in raw]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(masked, pa.string())], names=["doc_id", "first_byte", "end_byte", "masked"])

    slim = docs.select("doc_id", "text")
    return in_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, first_byte bigint, end_byte bigint, masked string")
