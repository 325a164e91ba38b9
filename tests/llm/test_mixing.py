import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from ratemill.llm import mixing
from tests.llm.common_rows import DOCS, empty, odd

needs_vocabulary = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary here")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 150))
def test_fit_budget_is_the_best_sum(bars, budget):
    lens, counts = [b[0] for b in bars], [b[1] for b in bars]
    take = mixing.fit_budget(lens, counts, budget)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert all(t == c for t, c, n in zip(take, counts, lens) if n == 0)
    sums = {sum(n * k for n, k in zip(lens, x)) for x in itertools.product(*[range(c + 1) for c in counts])}
    assert sum(n * t for n, t in zip(lens, take)) == max(s for s in sums if s <= budget)


def test_fit_budget_far_beyond_the_table():
    r = np.random.default_rng(3)
    lens, counts = np.arange(50, 3000, 7), r.integers(1, 400, len(np.arange(50, 3000, 7)))
    budget = int((lens * counts).sum()) // 3
    take = mixing.fit_budget(lens, counts, budget)
    assert (take <= counts).all() and (lens * take).sum() == budget
    assert np.corrcoef(take, counts)[0, 1] > 0.95  # the same share of every length, but for the rest


def best_sum(lens, counts, budget):
    reach = 1
    for n, c in zip(lens, counts):
        for _ in range(c):
            reach |= reach << int(n)
    return (reach & ((1 << budget + 1) - 1)).bit_length() - 1


@pytest.mark.parametrize(("few", "bits", "most", "low", "high", "most_count"), [(40, 1 << 28, 11, 20_000, 200_000, 1), (0, 1 << 20, 11, 20_000, 200_000, 1), (40, 1 << 24, 60, 5_000, 17_000, 3), (0, 60, 7, 0, 60, 4), (3, 200, 9, 1, 90, 3)])
def test_fit_budget_of_few_long_documents(monkeypatch, few, bits, most, low, high, most_count):
    monkeypatch.setattr(mixing, "FEW_UNITS", few)
    monkeypatch.setattr(mixing, "TABLE_BITS", bits)
    r = np.random.default_rng(most)
    for _ in range(60):
        lens = np.unique(r.integers(low, high, r.integers(2, most)))
        counts = r.integers(1, most_count + 1, len(lens))
        budget = int((lens * counts).sum() * r.random())
        take = mixing.fit_budget(lens, counts, budget, cells=8 if high < 100 else mixing.CELLS)
        assert ((0 <= take) & (take <= counts)).all()
        assert int((lens * take).sum()) == best_sum(lens, counts, budget)


def test_fit_budget_beyond_the_largest_set(monkeypatch):
    monkeypatch.setattr(mixing, "FEW_UNITS", 0)
    monkeypatch.setattr(mixing, "LARGEST", 1 << 12)
    r = np.random.default_rng(5)
    lens = np.unique(r.integers(300, 900, 60))
    budget = int(lens.sum()) // 2
    assert int((lens * mixing.fit_budget(lens, np.ones(len(lens), int), budget, cells=8)).sum()) == budget


@needs_vocabulary
def test_ties_and_very_long_documents(spark):
    """Of equally long documents the seeded hash decides, whatever their order; a document far beyond the table is one unit."""
    some = [(i, "same words here", "en", "a", 0) for i in range(30)] + [(100, "word " * 90_000, "en", "b", 0), (101, "two words", "en", "b", 0)]
    pick = lambda rows, **k: {(r.doc_id, r.source) for r in mixing.chosen(spark.createDataFrame(rows, DOCS), **k).collect()}
    got = pick(some, weights={"a": 1, "b": 1}, total=60)
    assert len([x for x in got if x[1] == "a"]) == 10 and (100, "b") not in got and (101, "b") in got
    assert got == pick(some[::-1], weights={"a": 1, "b": 1}, total=60)
    assert (100, "b") in pick(some, weights={"b": 1}, total=90_001)


@needs_vocabulary
def test_token_counts_are_exact():
    encoding = mixing._encoder(mixing.TOKENIZER)
    r = random.Random(5)
    letters = "ab e thin\n\tç漢字😀é01.,'s    \x1c"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 50))) for _ in range(2000)] + ["", " ", None, "it's  3,000 'll ", "a" * 5000]
    assert mixing.count_tokens(pa.array(texts)).tolist() == [len(encoding.encode_ordinary(t or "")) for t in texts]
    sliced = pa.array(texts).slice(7, 300)
    assert mixing.count_tokens(sliced).tolist() == [len(encoding.encode_ordinary(t or "")) for t in texts[7:307]]


def documents(spark):
    r = random.Random(9)
    return spark.createDataFrame([(i, " ".join("word" for _ in range(r.randrange(1, 60))), "en", r.choice(("a", "a", "a", "b", "c")), 0) for i in range(400)], DOCS)


@needs_vocabulary
def test_sources_meet_their_budgets(spark):
    df = documents(spark)
    got = mixing.chosen(df).toPandas()
    sums = got.groupby("source").n_tokens.sum()
    assert sums.min() == sums.max()
    assert got.doc_id.is_unique
    some = mixing.chosen(df, {"a": 3, "b": 1}, 2000).toPandas().groupby("source").n_tokens.sum().to_dict()
    assert some == {"a": 1500, "b": 500}
    assert sorted(mixing.chosen(df, class_rows=1).toPandas().n_tokens) == sorted(got.n_tokens)  # other draws, the same lengths
    assert sorted(mixing.chosen(df).toPandas().doc_id) == sorted(got.doc_id)
    assert sorted(mixing.chosen(df, seed=2).toPandas().doc_id) != sorted(got.doc_id)


@needs_vocabulary
def test_tiny_sources_do_not_cut_the_stage(spark):
    tiny = [(1000, "ten words", "en", None, 0)] + [(1001 + i, "a word", "en", f"tiny{i}", 0) for i in range(5)]
    df = documents(spark).union(spark.createDataFrame(tiny, DOCS))
    tokens = lambda d: {r.source: r.n for r in mixing.lengths(d).groupBy("source").agg({"n_tokens": "sum"}).toDF("source", "n").collect()}
    before, after = tokens(df), tokens(corpus_pipeline.stage_mixing(spark, df, ""))
    assert 0.89 * sum(before.values()) <= sum(after.values()) <= 0.9 * sum(before.values())
    assert set(after) == set(before) and all(after[s] == before[s] for s in before if s is None or s.startswith("tiny"))
    share = {s: after[s] / before[s] for s in "abc"}
    assert share["a"] < min(share["b"], share["c"])  # the hot source is tempered


@needs_vocabulary
def test_mixing_odd_rows(spark):
    df = odd(spark, clashing=True)
    units = mixing.chosen(df, {"src0": 1.0}, 10**9).toPandas()
    assert set(units.source) >= {"src0"}
    assert units[units.doc_id == 1].n_rows.tolist() == [2]
    mixed = mixing.mix(df, {"src0": 1.0}, 10**9)
    assert mixed.columns == df.columns
    assert mixed.where("source = 'src0'").count() == df.where("source = 'src0'").count()
    assert mixed.where("source = 'src1' AND text <> ''").count() == 0
    assert mixing.mix(df).where("text IS NULL").count() == 3  # they cost nothing
    assert mixing.chosen(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
