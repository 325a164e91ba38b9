import collections
import os

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ratemill.llm import mixing, near, pieces, toxicity
from tests.llm.common_rows import DOCS, LONG, empty, odd
from tests.llm.test_mixing import best_sum

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(HERE) or not os.path.exists(mixing.TOKENIZER), reason="no test tables here")


@pytest.mark.parametrize("name_and_stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_odd_rows(spark, name_and_stage):
    _, stage = name_and_stage
    for docs in (odd(spark), odd(spark, clashing=True), empty(spark)):
        out = stage(spark, docs, HERE)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


def documents(spark):
    return spark.read.parquet(f"{HERE}/documents.parquet")


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxicity_stage_drops_just_what_the_net_rejects(spark):
    docs = documents(spark)
    net = toxicity.model(docs, spark.read.parquet(f"{HERE}/labels.parquet"))
    want = set()
    for r in docs.collect():
        score = net.score(pa.array([r.text], pa.string()))[0] if r.text is not None else -1.0
        if score < net.thresholds.get(r.lang, net.overall):
            want.add(r.doc_id)
    assert set(by_id(corpus_pipeline.stage_toxicity(spark, docs, HERE))) == want
    assert 0.8 * docs.count() < len(want) < docs.count()


def copies(spark):
    """The documents with exact and near copies of some of them, nulls and empty texts."""
    docs = documents(spark)
    some = [r for r in docs.orderBy("doc_id").collect() if r.text and 40 < len(r.text.split()) < 400][:30]
    rows = []
    for i, r in enumerate(some):
        words = r.text.split()
        words[len(words) // 2 : len(words) // 2 + 1 + len(words) // 40] = ["changed"]
        rows += [(10_000 + i, r.text, r.lang, r.source, r.n_chars), (20_000 + i, " ".join(words), r.lang, r.source, r.n_chars)]
    rows += [(30_000, None, "en", "s", 0), (30_001, None, "en", "s", 0), (30_002, "", "en", "s", 0), (30_003, "", "en", "s", 0), (30_004, LONG, "en", "s", len(LONG)), (30_005, LONG, "en", "s", len(LONG))]
    return docs.unionByName(spark.createDataFrame(rows, DOCS))


def test_exact_stage_keeps_the_smallest_of_each_text(spark):
    docs = copies(spark)
    rows = by_id(docs)
    first = {}
    for i in sorted(rows):
        if rows[i] is not None:
            first.setdefault(rows[i], i)
    want = set(first.values()) | {i for i, t in rows.items() if t is None}
    assert set(by_id(corpus_pipeline.stage_exact(spark, docs, HERE))) == want


def test_near_stage_keeps_one_of_each_group(spark):
    docs = copies(spark)
    rows = by_id(docs)
    texts = {i: np.array([hash(w) for w in t.split()]) for i, t in rows.items() if t is not None}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts, key=lambda i: len(texts[i]))
    for k, j in enumerate(ids):
        n = len(texts[j])
        for i in reversed(ids[:k]):
            most = near._most(n, near.SIMILARITY)
            if n - len(texts[i]) > most:
                break
            if near.distance(texts[i], texts[j], most) <= most:
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {top(i) for i in texts}
    kept = set(by_id(corpus_pipeline.stage_near(spark, docs, HERE)))
    assert {i for i, t in rows.items() if t is None} <= kept
    # one of each group, the smallest; a group that isn't found whole would leave more
    assert groups <= kept and len(kept) <= len(groups) + 2 + 1


def test_mixing_stage_meets_every_budget(spark):
    docs = documents(spark)
    rows = docs.collect()
    n = dict(zip([r.doc_id for r in rows], mixing.count_tokens(pa.array([r.text for r in rows], pa.string())).tolist()))
    lens = collections.defaultdict(list)
    for r in rows:
        lens[r.source].append(n[r.doc_id])
    has = {s: sum(v) for s, v in lens.items()}
    total = int(sum(has.values()) * 0.9)
    low, high = 0.0, 1e9  # level at which the budgets sum to the total, by halving
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(h, level * h**0.7) for h in has.values()) > total:
            high = level
        else:
            low = level
    got = collections.Counter()
    for r in corpus_pipeline.stage_mixing(spark, docs, HERE).collect():
        got[r.source] += n[r.doc_id]
    for s, h in has.items():
        budget = min(h, int(low * h**0.7 + 1e-6))
        assert got[s] == best_sum(lens[s], [1] * len(lens[s]), budget)


def test_pieces_stage_is_the_library_s(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = by_id(documents(spark))
    got = {r.doc_id: r.pieces for r in corpus_pipeline.stage_pieces(spark, documents(spark), HERE).collect()}
    assert got == {i: library.encode(t) if t is not None else None for i, t in rows.items()}


def test_pipeline_runs_and_keeps_clean_documents(spark):
    got = corpus_pipeline.run(spark, HERE)
    docs = documents(spark)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:  # the same without the tables between
        kept = stage(spark, kept, HERE)
    assert {r.doc_id for r in got.collect()} == set(by_id(kept))
    assert 0.5 * docs.count() < got.count() < docs.count()
    assert got.where("round_trip").count() == got.count()


def test_all_eleven_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert set(entry.oracle_sql()) <= set(names)
