import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratemill.llm import exact, near, suffix
from ratemill.llm.common import content_id
from tests.llm.common_rows import DOCS, LONG, empty, odd, rows


def brute_owners(df):
    by = collections.defaultdict(list)
    for r in df.collect():
        if r.text is not None:
            by[r.text].append(r.doc_id)
    return {t: min((i for i in ids if i is not None), default=None) for t, ids in by.items()}


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1}, {"trie_bytes": 2_000}, {"hot_rows": 1, "trie_bytes": 500}])
def test_exact_owners(spark, options):
    df = odd(spark, clashing=True)
    want = brute_owners(df)
    texts = {(r.doc_id, len(r.text.encode()) if r.text is not None else None): r.text for r in df.collect()}
    got = exact.owners(df, **options).collect()
    assert len(got) == df.count()
    for r in got:
        text = texts.get((r.doc_id, r.n_bytes))
        assert r.owner_id == (want[text] if text is not None else r.doc_id)
    assert sum(r.keep for r in got) == len(want) + 3  # and each row without text


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "trie_bytes": 500}])
def test_exact_dedup_keeps_one_row_of_each_text(spark, options):
    df = odd(spark, clashing=True)
    got = exact.dedup(df, **options)
    assert got.columns == df.columns
    kept = got.select("doc_id", "text").collect()
    want = brute_owners(df)
    assert sorted(((r.doc_id, r.text) for r in kept if r.text is not None), key=repr) == sorted(((i, t) for t, i in want.items()), key=repr)
    assert sum(r.text is None for r in kept) == 3


def test_exact_empty(spark):
    assert exact.owners(empty(spark)).count() == 0
    assert exact.dedup(empty(spark)).columns == empty(spark).columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=60), st.integers(200, 3000))
def test_trie_is_a_dictionary(keys, limit):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        first = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        got = {p: (o, f) for p, o, f in exact._owners(((k, i, i) for i, k in enumerate(keys)), limit, folder)}
        assert got == {i: (first[k], first[k] == i) for i, k in enumerate(keys)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=90), st.lists(st.integers(0, 4), max_size=90), st.integers(0, 90))
def test_distance(a, b, most):
    assert near.distance(np.array(a, np.int64), np.array(b, np.int64), most) == min(levenshtein(a, b), most + 1)


def test_banded_and_diagonals_agree():
    r = random.Random(4)
    for _ in range(60):
        a = [r.randrange(50) for _ in range(r.randrange(1, 200))]
        b = [x for x in a if r.random() > 0.1]
        b = [r.randrange(50) if r.random() < 0.1 else x for x in b]
        want = levenshtein(a, b)
        assert near._diagonals(a, b, 120) == min(want, 121)
        if b:
            assert near._banded(np.array(a), np.array(b), max(want, 1)) == want


def variant(r, words, share):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < share / 3 else [f"new{r.randrange(10**6)}"] if x < share * 2 / 3 else [w, f"more{r.randrange(10**6)}"] if x < share else [w]
    return " ".join(out)


def test_near_groups_find_what_brute_force_finds(spark):
    r = random.Random(7)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(25, 220))] for _ in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(b) for b in base] + [variant(r, b, r.choice((0.02, 0.06, 0.12))) for b in base for _ in range(2)] + [passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(90)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.group_id for x in near.near_groups(df).collect()}
    ids = [np.unique(t.split(), return_inverse=False) for t in texts]
    assert len(ids) == len(texts)
    pairs = hit = 0
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    seqs = [np.array([vocabulary[w] for w in t.split()]) for t in texts]
    joined = set()
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(seqs[i]), len(seqs[j])) + 1e-9)
            if near.distance(seqs[i], seqs[j], most) <= most:
                pairs += 1
                hit += got[i] == got[j]
                joined |= {i, j}
    assert pairs > 100 and hit / pairs >= 0.9
    assert all(got[i] == i for i in range(len(texts)) if i not in joined)


def test_near_groups_of_one_original_and_many_copies(spark):
    r = random.Random(11)
    texts = []
    for _ in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(base)] + [" ".join(f"n{r.randrange(10**6)}" if i in edited else w for i, w in enumerate(base)) for edited in (set(r.sample(range(120), 16)) for _ in range(100))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {x.doc_id: x.group_id for x in near.near_groups(df).collect()}
    # each copy is within 0.8 of its original only
    assert sum(got[i] == i // 101 * 101 for i in got) >= 0.98 * len(texts)


def edited(r, words, errors):
    """Words with that many substitutions, deletions and insertions."""
    out = list(words)
    for _ in range(errors):
        i, new = r.randrange(len(out)), f"n{r.randrange(10**9)}"
        out[i : i + 1] = r.choice(([new], [new], [], [new, out[i]]))
    return out


def test_short_near_copies_share_a_bucket():
    r = random.Random(13)
    for n in [*range(5, 15), 15, 20, 30, 40, 60]:
        pairs = []
        while len(pairs) < 100:
            a = [f"w{r.randrange(10**9)}" for _ in range(n)]
            b = edited(r, a, r.randrange(1, n // 5 + 1) if n <= near.EXACT_WORDS else n // 5)
            if b and near.similar(pa.array([" ".join(a)]), pa.array([" ".join(b)]), 0.8)[0] and max(len(a), len(b)) <= (14 if n <= 14 else 99):
                pairs += [(" ".join(a), " ".join(b))]
        row, key = near.buckets(pa.array([t for p in pairs for t in p]))
        keys = [set(key[row == i].tolist()) for i in range(200)]
        found = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(100))
        assert found == 100 if n <= 14 else found >= 90, (n, found)


def test_short_near_copies_are_grouped(spark):
    texts = ["one two three four five", "one two other four five", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta GAMMA delta epsilon zeta ETA theta iota kappa", "one two three", "one two four"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {x.doc_id: x.group_id for x in near.near_groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def test_near_odd_rows(spark):
    df = odd(spark, clashing=True)
    got = near.near_groups(df).collect()
    assert len(got) == df.count()
    groups = collections.Counter(r.group_id for r in got if r.keep)
    assert sum(r.keep for r in got) == sum(groups.values())
    by = {(r.doc_id, r.group_size): r.group_id for r in got}
    assert by[(2, 3)] == 1 and by[(8, 2)] == 7 and by[(6, 2)] == 5 and by[(None, 2)] == 12
    kept = near.dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.keep for r in got)
    assert kept.where("doc_id = 1").count() == 1 and kept.where("text IS NULL").count() == 3
    assert near.near_groups(empty(spark)).count() == 0 and near.dedup(empty(spark)).count() == 0


def test_crowded_buckets_are_not_compared_pair_by_pair(spark, monkeypatch):
    """5,000 unlike texts that share a license line, with near copies among them: few pairs are aligned, and none of the copies is lost."""
    r = random.Random(8)
    line = " ".join(f"license{i}" for i in range(40))
    texts = [line + " " + " ".join(f"w{r.randrange(20_000)}" for _ in range(r.randrange(40, 80))) for _ in range(5000)]
    copies = []
    for i in range(0, 600, 3):
        words = texts[i].split()
        for at in r.sample(range(40, len(words)), len(words) // 8):
            words[at] = f"new{r.randrange(10**6)}"
        copies.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts + copies)], DOCS)
    aligned = []
    compare = near._compare
    monkeypatch.setattr(near, "_compare", lambda pairs, *more: (aligned.append(pairs.count()), compare(pairs, *more))[1])
    got = {x.doc_id: x.group_id for x in near.near_groups(df).collect()}
    assert sum(got[5000 + k] == got[3 * k] for k in range(200)) >= 195
    assert max(collections.Counter(got.values()).values()) < 10
    assert sum(aligned) < 400_000  # of 13 million pairs


def test_rarest_words_lose_no_near_copy(spark):
    r = random.Random(11)
    texts = set()
    for _ in range(25):
        base = [f"a{r.randrange(15)}" for _ in range(r.randrange(1, 30))]
        for _ in range(6):
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 4)):
                at = r.randrange(len(words) + 1)
                words[at : at + r.randrange(2)] = [f"a{r.randrange(15)}"] * r.randrange(2)
            texts.add(" ".join(words) or "a")
    texts = sorted(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", "text", content_id(F.col("text")).alias("cid"))
    crowd = df.select("cid", F.size(F.split("text", " ")).alias("n"), F.col("cid").alias("root"), F.lit(True).alias("open"))
    ids = {bytes(x.cid): x.doc_id for x in df.collect()}
    got = {frozenset((ids[bytes(x.a)], ids[bytes(x.b)])) for x in near.crowded_pairs(crowd, df, near.SIMILARITY).collect()}
    split = [np.array([hash(w) for w in t.split()]) for t in texts]
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if near.distance(split[i], split[j], 99) <= near._most(max(len(split[i]), len(split[j])), near.SIMILARITY)}
    assert len(want) > 50 and want <= got


def test_joined_texts_never_meet(spark):
    """Texts of one root, however many they are, give no rare part to meet under; those of two roots do."""
    base = [f"a{i}" for i in range(20)]
    df = spark.createDataFrame([(i, " ".join([*base[:i], "new", *base[i:]])) for i in range(12)], "doc_id long, text string").select("doc_id", "text", content_id(F.col("text")).alias("cid"))
    for roots, some in ((1, False), (2, True)):
        crowd = df.select("cid", F.lit(21).alias("n"), (F.col("doc_id") % roots).cast("string").cast("binary").alias("root"), F.lit(True).alias("open"))
        runs = df.select("cid", "text").mapInArrow(near._run_batches, "cid binary, run bigint, pos bigint, size bigint, part boolean").join(crowd, "cid")
        assert (near._rarest(runs, near.SIMILARITY).count() > 0) == some
        assert near.crowded_pairs(crowd, df, near.SIMILARITY).count() == (36 if some else 0)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables here")
def test_recall_on_the_small_table(spark):
    """Against brute force over all pairs of sf0.01 whose words allow it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({t for (t,) in docs.where("text IS NOT NULL").select("text").collect()})
    split = [np.array([hash(w) for w in t.split()]) for t in texts]
    bags = [collections.Counter(x.tolist()) for x in split]
    holders = collections.defaultdict(list)
    pairs = 0
    edges = []
    for j in sorted(range(len(texts)), key=lambda k: len(split[k])):
        n = len(split[j])
        shared = collections.Counter()
        for w, k in bags[j].items():
            for i, m in holders[w]:
                shared[i] += min(k, m)
        for i, both in shared.items():
            most = near._most(n, near.SIMILARITY)
            if both >= n - most and n - len(split[i]) <= most:
                pairs += 1
                if near.distance(split[i], split[j], most) <= most:
                    edges.append((texts[i], texts[j]))
        for w, k in bags[j].items():
            holders[w].append((j, k))
    got = {}
    groups = {x.doc_id: x.group_id for x in near.near_groups(docs).collect()}
    for x in docs.where("text IS NOT NULL").collect():
        got[x.text] = groups[x.doc_id]
    found = sum(got[a] == got[b] for a, b in edges)
    assert len(edges) > 20 and found >= 0.95 * len(edges)


def test_sketch_keeps_order():
    a = " ".join(f"w{i}" for i in range(60))
    turned = " ".join(f"w{i}" for i in list(range(30, 60)) + list(range(30)))
    _, s = near.sketches(pa.array([a, a, turned, None, "", "one"]))
    assert (s[0] == s[1]).all() and len(s) == 4
    assert 0 < (s[0] == s[2]).sum() < near.SKETCHES


def brute_passages(df, length):
    texts = {(r.doc_id, r.text) for r in df.collect() if r.text is not None}
    windows, where = collections.Counter(), []
    for ident, t in texts:
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x00-\x20]+", t.encode())]
        where.append((ident, words))
    for r in df.where("text IS NOT NULL").collect():
        words = [m.group() for m in re.finditer(rb"[^\x00-\x20]+", r.text.encode())]
        for i in range(len(words) - length + 1):
            windows[tuple(words[i : i + length])] += 1
    out = set()
    for ident, words in where:
        cur = None
        for i in range(len(words) - length + 1):
            if windows[tuple(w[2] for w in words[i : i + length])] > 1:
                a, b = words[i][0], words[i + length - 1][1]
                if cur and a < cur[1]:
                    cur[1] = b
                else:
                    out |= {(ident, *cur)} if cur else set()
                    cur = [a, b]
        out |= {(ident, *cur)} if cur else set()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 9), st.sets(st.integers(0, 79), max_size=4))
def test_repeated_symbols(symbols, length, marks):
    a = [100 + i if i in marks else x for i, x in enumerate(symbols)]
    a[-1] = 999
    c = collections.Counter(tuple(a[i : i + length]) for i in range(len(a) - length + 1))
    assert suffix.repeated(np.array(a), length).tolist() == [i + length <= len(a) and c[tuple(a[i : i + length])] > 1 for i in range(len(a))]


@pytest.mark.parametrize(("length", "anchor", "block", "hot"), [(8, 3, 1 << 20, 10**9), (5, 5, 60, 10), (12, 4, 300, 0), (1, 12, 100, 20), (5, 5, 60, 300), (8, 3, 100, 1000)])
def test_passages(spark, length, anchor, block, hot):
    r = random.Random(length)
    common = [" ".join(f"c{r.randrange(30)}" for _ in range(20)) for _ in range(4)]
    texts = [" ".join([f"x{r.randrange(10**6)}" for _ in range(r.randrange(12))] + [r.choice(common)] + [f"y{r.randrange(50)}" for _ in range(r.randrange(12))]) for _ in range(50)] + ["ab " * 40, "ab  ab\nab", ""]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {tuple(x) for x in suffix.passages(df, length, anchor, block, hot).collect()} == brute_passages(df, length)


def test_one_anchor_beyond_a_block(spark):
    """An anchor of more text than a block, and more than HOT_BYTES too, whose windows all differ but for some that repeat."""
    r = random.Random(12)
    anchor = " ".join(f"!{i}" for i in range(12))
    body = lambda: " ".join(f"v{r.randrange(400)}" for _ in range(38))
    texts = [f"{anchor} {body()}" for _ in range(2500)]
    texts += [f"x {t}" for t in texts[:40]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {(i, 0, len(t)) for i, t in enumerate(texts[:40])} | {(2500 + i, 2, 2 + len(t)) for i, t in enumerate(texts[:40])}
    for block, hot in ((1 << 14, 1 << 30), (1 << 14, 1 << 16)):
        assert {tuple(x) for x in suffix.passages(df, block=block, hot_bytes=hot).collect()} == want


def test_passages_odd_rows(spark):
    df = odd(spark, clashing=True)
    got = {tuple(x) for x in suffix.passages(df).collect()}
    assert got == brute_passages(df, suffix.LENGTH) and {(8, 0, len(LONG))} <= got
    assert rows(suffix.passages(df, 3, 2)) == sorted(brute_passages(df, 3), key=repr)
    assert suffix.passages(empty(spark)).count() == 0
