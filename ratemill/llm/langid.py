"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it; in both steps every pair of classes has a linear
support vector machine over hashed byte n-grams, and most votes win, the sum of margins deciding ties. A text's
features are the relative frequencies of its n-grams, so a score is the mean weight of its n-grams: whole
texts are scored by looking weights up, without a feature vector.

Fitting uses at most SAMPLE rows with a language, those with the smallest seeded hash of doc_id. Languages that FAMILIES doesn't name
are families of their own.

Defined results: NULL text has NULL family, language and margin; a text without a letter is "und" with margin 0. Texts of any length
are scored whole. Ties of votes go to the larger sum of margins, ties of that too to the first class by name. Every row has its own
result, rows that repeat too; an empty table gives an empty one. Columns but doc_id and text (and lang to fit) aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratemill.llm.common import chunks, in_arrow, text_bytes

SAMPLE = 3_000
SEED = 23
BITS = 13
ORDERS = (1, 2, 3)
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "uk", "pl", "cs", "bg")}
EPOCHS = 8
PENALTY = 1e-3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def _codes(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; 1 << BITS where the text ends within it."""
    code = data.astype(np.uint32)
    for j in range(1, n):
        code[: len(code) - j] = code[: len(code) - j] * np.uint32(0x01000193) ^ data[j:]
    code = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
    for j in range(1, n):
        code[np.maximum(at[1:] - j, at[:-1])[at[1:] > at[:-1]]] = 1 << BITS
    return code


def frequencies(col: pa.Array) -> np.ndarray:
    """Relative n-gram frequencies of each text, dense."""
    data, at = text_bytes(col)
    data = _FOLD[data]
    n = len(at) - 1
    out = np.zeros((n, (1 << BITS) + 1), np.float32)
    for k in ORDERS:
        code = _codes(data, at, k)
        for i in range(n):
            out[i] += np.bincount(code[at[i] : at[i + 1]], minlength=out.shape[1])
    out[:, -1] = 0
    return out / np.maximum(out.sum(1, keepdims=True), 1)


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str | None, str, str]]  # (family or None for the first step, class, class)
    weights: np.ndarray  # (buckets + 1, pairs); a score above 0 is a vote for the first class
    bias: np.ndarray

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each text in every pair, and whether it has a letter."""
        data, at = text_bytes(col)
        data = _FOLD[data]
        n = np.diff(at)
        full = np.flatnonzero(n)
        total = np.zeros((len(n), len(self.pairs)))
        grams = np.zeros(len(n))
        letters = np.zeros(len(n), bool)
        if len(full):
            letters[full] = np.maximum.reduceat(data, at[:-1][full]) > 32
            for k in ORDERS:
                code = _codes(data, at, k)
                for p in range(len(self.pairs)):
                    total[full, p] += np.add.reduceat(self.weights[:, p][code], at[:-1][full])
                grams += np.maximum(n - k + 1, 0)
        return total / np.maximum(grams, 1)[:, None] + self.bias, letters

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores, letters = self.scores(col)
        n = len(scores)
        fam, margin = self._vote(scores, None, self.families)
        lang = np.full(n, "und", object)
        fam_name = np.array(self.families, object)[fam] if self.families else np.full(n, "und", object)
        for f in self.families:
            mine = fam_name == f
            pick, inner = self._vote(scores, f, self.members[f])
            lang[mine] = np.array(self.members[f], object)[pick][mine]
            if len(self.members[f]) > 1:
                margin[mine] = np.minimum(margin, inner)[mine] if len(self.families) > 1 else inner[mine]
        lang[~letters], fam_name[~letters], margin[~letters] = "und", "und", 0.0
        return fam_name, lang, margin

    def _vote(self, scores: np.ndarray, within: str | None, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros((len(scores), max(len(classes), 1)))
        sums = np.zeros_like(votes)
        for p, (f, a, b) in enumerate(self.pairs):
            if f == within and a in classes and b in classes:
                s = scores[:, p]
                i, j = classes.index(a), classes.index(b)
                votes[:, i] += s > 0
                votes[:, j] += s <= 0
                sums[:, i] += s
                sums[:, j] -= s
        spread = np.abs(sums).max(1, keepdims=True)
        pick = np.argmax(votes + sums / (1 + 4 * np.maximum(spread, 1e-12)), axis=1)
        return pick, sums[np.arange(len(scores)), pick]


def _machine(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine: averaged subgradient steps on the hinge loss."""
    w = np.zeros(x.shape[1], np.float32)
    b, t = 0.0, 0
    mean_w, mean_b, taken = np.zeros_like(w), 0.0, 0
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 32):
            i = order[k : k + 32]
            t += 1
            rate = 1 / (PENALTY * (t + 100))
            inside = (y[i] * (x[i] @ w + b) < 1) * weight[i] * y[i] / len(i)
            w = w * np.float32(1 - rate * PENALTY) + np.float32(rate) * (inside @ x[i])
            b += rate * float(inside.sum()) * 0.01
            if epoch >= epochs // 2:
                mean_w += w
                mean_b += b
                taken += 1
    return mean_w / max(taken, 1), mean_b / max(taken, 1)


def fit(texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + 1
    x = np.concatenate([frequencies(pa.array(texts[k : k + 200], pa.string())) for k in range(0, len(texts), 200)]) if texts else np.zeros((0, size), np.float32)
    scale = 1 / np.sqrt(x.mean(0) + 1e-6) if len(x) else np.ones(size, np.float32)
    x *= scale.astype(np.float32)
    lang = np.array(langs, object)
    fam = np.array([family(v, families) for v in langs], object)
    names = sorted(set(fam))
    members = {f: sorted(set(lang[fam == f])) for f in names}
    pairs: list = [(None, a, b) for a, b in itertools.combinations(names, 2)]
    pairs += [(f, a, b) for f in names for a, b in itertools.combinations(members[f], 2)]
    weights, bias = np.zeros((size, len(pairs)), np.float32), np.zeros(len(pairs))
    for p, (f, a, b) in enumerate(pairs):
        of = fam if f is None else lang
        some = (of == a) | (of == b)
        w, bias[p] = _machine(x[some], np.where(of[some] == a, 1, -1).astype(np.float32), rng, epochs)
        weights[:, p] = w * scale
    weights[-1] = 0
    return Model(names, members, pairs, weights, bias)


def model(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    some = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("t.*").collect()
    return fit([r.text for r in rows], [r.lang for r in rows], seed=seed)


def identify(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, family, language and margin of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                text = batch.column("text")
                none = np.asarray(text.is_null())
                fam, lang, margin = m.predict(text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fam, pa.string(), mask=none), pa.array(lang, pa.string(), mask=none), pa.array(margin, pa.float64(), mask=none)], names=["doc_id", "family", "language", "margin"])

    slim = docs.select("doc_id", "text")
    ident = slim.schema["doc_id"].dataType.simpleString()
    return in_arrow(slim, run, f"doc_id {ident}, family string, language string, margin double")
