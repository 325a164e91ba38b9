import os
import random
import time

import pyarrow as pa
import pytest

from ratemill.llm import pieces
from tests.llm.common_rows import empty, odd

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model here")


def texts():
    r = random.Random(3)
    letters = "ab e thin\n\tç漢字😀é01.,<x0A> ▁the  "
    out = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    out += [" " * k + x + " " * j for k in range(40) for x in ("", "a", "the", "漢") for j in (0, 1, 5, 17)]
    words = "understanding internationalisation über Straße l'été mañana 12345 aaaaaaaa theththe".split()
    return out + ["".join(r.choice(words) for _ in range(4)) for _ in range(1000)] + ["", "thing" * 2000]


def test_same_as_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    some = texts()
    ids, first = pieces.machine().encode_batch(pa.array(some))
    want = library.encode(some, num_threads=1)
    assert [ids[first[i] : first[i + 1]].tolist() for i in range(len(some))] == want
    assert [pieces.machine().decode(w) for w in want] == library.decode(want)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize(("rule", "squeeze", "dummy"), [("nmt_nfkc", True, True), ("nfkc_cf", False, True), ("nmt_nfkc_cf", True, False), ("identity", True, True)])
def test_normaliser_is_the_library_s(tmp_path, rule, squeeze, dummy):
    """The given model's pieces under other normalisers, whose character maps the library has ready made."""
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    charmap = next((dict(pieces._fields(v)).get(2, b"") for k, v in pieces._fields(proto) if k == 3), b"")
    spec = (b"\x12" + _varint(len(charmap)) + charmap if charmap else b"") + bytes([0x18, dummy, 0x20, squeeze, 0x28, 1])
    path = tmp_path / "other.model"
    path.write_bytes(open(pieces.MODEL, "rb").read() + b"\x1a" + _varint(len(spec)) + spec)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    m = pieces.Machine(str(path))
    r = random.Random(4)
    letters = "Ab e ßÅ①ｶﾞ㌔ﬁ\u0301\u00ad\u200b\u3000İ\t\x07ﷺ漢 x e\u0301"
    some = ["".join(r.choice(letters) for _ in range(r.randrange(0, 30))) for _ in range(1500)] + ["", " ", "   ", "\u00ad", " \u3000 a  b ", "Ａ" * 300] + texts()[:500]
    assert [m.normalise(t) for t in some] == [library.normalize(t) for t in some]
    ids, first = m.encode_batch(pa.array(some))
    assert [ids[first[i] : first[i + 1]].tolist() for i in range(len(some))] == library.encode(some, num_threads=1)


def test_long_runs():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    m = pieces.machine()
    some = [" " * n + x for n in (41, 100, 997, 5000, 100_000) for x in ("", "word", "漢")] + ["a" * 50_000, "ab" * 20_000, "▁" * 3000, "x" + " " * 7777 + "y"]
    began = time.perf_counter()
    got = [m.encode(t) for t in some]
    assert time.perf_counter() - began < 15
    assert got == library.encode(some, num_threads=1)
    began = time.perf_counter()
    m.encode(" " * 100_000)
    assert time.perf_counter() - began < 1
    for n in (2, 3, 17, 60):  # the general rule and the run's machine are one
        assert [m.ids[p] for p in m.merged(pieces.BLANK * n)] == m._run(n)


def test_shortest_path_of_a_unigram_model():
    m = object.__new__(pieces.Machine)
    m.pieces, m.scores = ["<unk>", "▁a", "b", "ab", "▁", "a", "▁ab"], [0, -1.0, -2.0, -2.5, -1.0, -2.0, -3.4]
    m.ids = {p: i for i, p in enumerate(m.pieces) if i}
    m.unigram, m.byte, m.unknown, m.pairs, m.ends = True, {}, 0, {}, {}
    for p, i in m.ids.items():
        node = m.ends
        for c in reversed(p):
            node = node.setdefault(c, {})
        node[pieces._END] = i
    assert list(m.paths(["▁a", "▁ab", "▁abx", "▁aab"])) == [(1,), (1, 2), (1, 2, 0), (1, 3)]


def test_encode_odd_rows(spark):
    df = odd(spark, clashing=True)
    got = pieces.encode(df).collect()
    assert len(got) == df.count()
    assert sum(r.pieces is None for r in got) == 3
    for r in got:
        assert r.n_pieces == (len(r.pieces) if r.pieces is not None else None)
        assert r.round_trip == (None if r.pieces is None else r.doc_id != 11)  # that text has a U+2581 of its own
    assert pieces.encode(empty(spark)).count() == 0
