import itertools
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from ratemill.llm import linkrank, tiff, tiff_write


@pytest.mark.parametrize(("kind", "compression"), list(itertools.product(("u1", "u2", "u4", "i2", "f4", "f8"), ("none", "packbits", "lzw", "deflate"))))
def test_round_trip(kind, compression):
    rng = np.random.default_rng(1)
    for order, big, shape in itertools.product("<>", (False, True), (3, (16, 16), (16, 32))):
        for predictor in (1, 3) if kind[0] == "f" else (1, 2):
            image = rng.normal(0, 50, (int(rng.integers(1, 60)), int(rng.integers(1, 50)), int(rng.integers(1, 5)))).astype(kind) if kind != "u1" else rng.integers(0, 4, (37, 29, 3)).astype("u1")
            got = list(tiff.pages(tiff_write.write([image, image[:1]], [(compression, predictor, shape)] * 2, order, big)))
            assert [p["error"] for p in got] == [None, None]
            assert got[0]["pixels"] == image.astype(f"<{kind}").tobytes() and got[1]["height"] == 1
            assert (got[0]["compression"], got[0]["predictor"], got[0]["layout"]) == (compression, predictor, "tiles" if isinstance(shape, tuple) else "strips")


def test_lzw_beyond_the_table():
    noise = np.random.default_rng(2).integers(0, 256, 90_000).astype("u1").tobytes()
    for data in (noise, b"ab" * 50_000, b"", b"x", bytes(range(256)) * 40):
        assert tiff.unlzw(tiff_write.lzw(data)) == data
        assert tiff.unpackbits(tiff_write.packbits(data)) == data


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_predictor_over_narrow_samples(depth):
    def packed(values):
        return np.packbits((values[..., None] >> np.arange(depth - 1, -1, -1) & 1).astype("u1").reshape(len(values), -1), axis=1)

    values = np.random.default_rng(depth).integers(0, 1 << depth, (5, 13, 1))
    stored = packed(np.concatenate([values[:, :1], np.diff(values, axis=1)], 1) % (1 << depth))
    file = tiff_write.write([stored[..., None]], [("none", 1, 5)])
    file = file.replace(struct.pack("<HHII", 256, 4, 1, stored.shape[1]), struct.pack("<HHII", 256, 4, 1, 13))
    for tag, old, new in ((258, 8, depth), (317, 1, 2)):
        file = file.replace(struct.pack("<HHIHH", tag, 3, 1, old, 0), struct.pack("<HHIHH", tag, 3, 1, new, 0))
    (page,) = tiff.pages(file)
    assert page["error"] is None and (page["width"], page["bits"], page["predictor"]) == (13, depth, 2)
    assert page["pixels"] == packed(values).tobytes()


def test_broken_files_never_raise():
    r = random.Random(3)
    image = np.arange(600, dtype="u2").reshape(20, 30, 1)
    whole = tiff_write.write([image, image], [("lzw", 2, 4), ("deflate", 1, (16, 16))])
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(3):
            data[r.randrange(len(data))] = r.randrange(256)
        for page in tiff.pages(bytes(data)[: r.randrange(len(data) + 1)]):
            assert (page["error"] is None) == (page["pixels"] is not None)
    assert [p["error"] for p in tiff.pages(b"")] == ["no TIFF header"]


def by_hand(entries, body=b"", order="<", start=8):
    """A TIFF file with one directory: entries of (tag, kind, values), body from byte 8 on."""
    letters = {3: "H", 4: "I"}
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body
    out += struct.pack(order + "H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + letters[kind], value).ljust(4, b"\0")
    return out + b"\0\0\0\0"


def grey(width, height, packing, body, bits=8, order="<", **more):
    tags = [(256, 4, width), (257, 4, height), (258, 3, bits), (259, 3, packing), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(body)), *more.get("extra", [])]
    return by_hand(tags, body, order)


def test_bytes_that_others_made():
    """Packed bytes as the standards print them, not by our own writer."""
    # the run and literals of the PackBits note, 24 bytes
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpackbits(packed) == plain
    # the worked LZW example of TIFF 6.0, section 13: 7 7 7 8 8 7 7 6 6 as 256 7 258 8 8 258 6 6 257, nine bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    want = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unlzw(lzw) == want
    # zlib stream of fixed codes, as other programs make it
    deflated = zlib.compress(want, 9)
    for order, packing, body, pixels in (("<", 5, lzw, want), (">", 5, lzw, want), (">", 8, deflated, want), ("<", 32946, deflated, want), ("<", 1, want, want), (">", 32773, packed, plain)):
        (page,) = tiff.pages(grey(3 if len(pixels) == 9 else 6, 3 if len(pixels) == 9 else 4, packing, body, order=order))
        assert page["error"] is None and bytes(page["pixels"]) == pixels
    # 16 bits, big-endian, horizontal differences 1, +2, -1: 1 3 2
    (page,) = tiff.pages(grey(3, 1, 1, bytes.fromhex("00010002FFFF"), 16, ">", extra=[(317, 3, 2)]))
    assert np.frombuffer(page["pixels"], "<u2").tolist() == [1, 3, 2]
    # the floating-point predictor over 1.0 and 2.0 (3F800000 40000000): bytes by significance, then differences
    body = bytes.fromhex("3F408000 0000 0000".replace(" ", ""))
    stored = bytes([body[0], *[(b - a) % 256 for a, b in zip(body, body[1:])]])
    (page,) = tiff.pages(grey(2, 1, 1, stored, 32, extra=[(317, 3, 3), (339, 3, 3)]))
    assert np.frombuffer(page["pixels"], "<f4").tolist() == [1.0, 2.0]


def test_pages_take_no_more_than_they_have_room_for():
    side = 6000
    bomb = zlib.compress(bytes(60 << 20), 9)
    for packing, body in ((8, bomb), (32773, bytes([129, 7]) * 400_000), (5, tiff_write.lzw(bytes(40 << 20)))):
        tracemalloc.start()
        (page,) = tiff.pages(grey(side, 200, packing, body))
        assert page["error"] is None and len(page["pixels"]) == side * 200
        assert tracemalloc.get_traced_memory()[1] < side * 200 + 8 * tiff.STEP
        tracemalloc.stop()
    (page,) = tiff.pages(grey(side, side, 8, bomb), max_page=1 << 20)
    assert "over" in page["error"] and page["pixels"] is None
    (page,) = tiff.pages(grey(side, 20_000, 8, bomb))
    assert page["error"] == "a strip or tile is too short"


def test_narrow_tiles():
    values = np.random.default_rng(7).integers(0, 4, (16, 32), dtype="u1")
    bits = lambda v: np.packbits(np.unpackbits(v[..., None], axis=2)[..., 6:].reshape(len(v), -1), axis=1).tobytes()
    tiles = [bits(values[:, :16]), bits(values[:, 16:])]
    body = b"".join(tiles)
    tags = [(256, 4, 21), (257, 4, 13), (258, 3, 2), (259, 3, 1), (277, 3, 1), (322, 4, 16), (323, 4, 16)]
    head = 8 + len(body)
    lists = struct.pack("<4I", 8, 8 + len(tiles[0]), len(tiles[0]), len(tiles[1]))
    out = b"II" + struct.pack("<HI", 42, head + 16) + body + lists + struct.pack("<H", len(tags) + 2)
    for tag, kind, value in tags:
        out += struct.pack("<HHI", tag, kind, 1) + struct.pack("<I", value)
    out += struct.pack("<HHII", 324, 4, 2, head) + struct.pack("<HHII", 325, 4, 2, head + 8) + b"\0\0\0\0"
    (page,) = tiff.pages(out)
    assert page["error"] is None and bytes(page["pixels"]) == bits(values[:13, :21])


@pytest.mark.parametrize("key", ["page", "pixels", "key", "Error"])
def test_keys_named_like_columns_of_the_result(spark, key):
    file = tiff_write.write([np.arange(12, dtype="u1").reshape(3, 4, 1)], [("none", 1, 3)])
    df = spark.createDataFrame([(5, bytearray(file), 1)], f"`{key}` long, data binary, width int")
    got = tiff.decode(df, key, "data")
    assert got.columns[0] == (key if key == "key" else f"key_{key}") and len(set(got.columns)) == len(got.columns)
    assert got.first()[0] == 5


def test_decode_odd_rows(spark):
    image = np.arange(12, dtype="u1").reshape(3, 4, 1)
    file = tiff_write.write([image, image], [("none", 1, 3), ("packbits", 1, 1)])
    df = spark.createDataFrame([(1, bytearray(file), "p"), (1, bytearray(file), "p"), (2, None, "p"), (None, bytearray(file), None), (3, bytearray(b""), "p"), (4, bytearray(b"GIF89a"), "p")], "id long, data binary, page string")
    got = tiff.decode(df, "id", "data").collect()
    assert sorted((str(r.id), r.page, r.error is None) for r in got) == [("1", 0, True), ("1", 0, True), ("1", 1, True), ("1", 1, True), ("3", 0, False), ("4", 0, False), ("None", 0, True), ("None", 1, True)]
    assert all(bytes(r.pixels) == image.tobytes() for r in got if r.error is None)
    assert tiff.decode(df.where("false"), "id", "data").count() == 0
    vectors = spark.createDataFrame([(1, [0.5] * 64), (2, []), (3, None), (4, [0.25, None, float("nan")])], "vec_id long, embedding array<float>")
    made = tiff.decode(tiff_write.of_embeddings(vectors), "vec_id", "tiff").collect()
    assert len(made) == 8 and all(r.error is None for r in made)
    assert next(bytes(r.pixels) for r in made if (r.vec_id, r.page) == (1, 0)) == np.full(64, 0.5, "<f4").tobytes()


PAGES = [
    (1, "http://a.org/x", '<a href="http://b.com/">'), (2, "http://b.com/y", '<a href="//c.com:80/z"> <a href="https://spam.net">'), (3, "https://c.com", "x"), (4, "http://spam.net/", '<a href="http://b.com">'),
    (5, None, "z"), (6, "http://d.com/", "mail me@spam.net"), (7, "nohost", None), (8, "http://B.com./q", '<a href="http://c.com">'), (8, "http://B.com./q", '<a href="http://c.com">'),
]


def pagerank(edges, nodes, seeds, damping, rounds=400):
    rank = {n: 0.0 for n in nodes}
    start = {n: (1 / len(seeds) if n in seeds else 0.0) for n in nodes}
    rank.update(start)
    total = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not total[n])
        rank = {n: (1 - damping) * start[n] + damping * (sum(rank[s] * w / total[s] for s, d, w in edges if d == n) + lost * start[n]) for n in nodes}
    top = max(rank.values())
    return {n: v / top for n, v in rank.items()}


def test_ranks_are_those_of_the_power_method(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    edges = [tuple(r) for r in linkrank.edges(df).collect()]
    assert set(edges) == {("a.org", "b.com", 1.0), ("b.com", "c.com", 3.0), ("b.com", "spam.net", 1.0), ("spam.net", "b.com", 1.0), ("d.com", "spam.net", 1.0)}
    nodes = {"a.org", "b.com", "c.com", "d.com", "spam.net"}
    trust = pagerank(edges, nodes, {"a.org"}, linkrank.DAMPING)
    distrust = pagerank([(d, s, w) for s, d, w in edges], nodes, {"spam.net"}, linkrank.DAMPING)
    hosts = df.select(linkrank.host_of(df.url).alias("host"))
    got = linkrank.ranks(linkrank.edges(df), hosts, ("a.org",), ("spam.net",), rounds=120, tolerance=1e-9).collect()
    assert {r.host for r in got} == nodes
    for r in got:
        assert abs(r.trust - trust[r.host]) < 1e-6 and abs(r.distrust - distrust[r.host]) < 1e-6


def test_filter_odd_rows(spark):
    df = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, trust string")
    got = linkrank.filter_urls(df, ("a.org",), ("spam.net",))
    assert got.count() == len(PAGES)
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert verdict[4] == "blocked" and verdict[6] == "blocked" and verdict[1] == "trusted" and verdict[5] == verdict[7] == "unknown"
    assert linkrank.filter_urls(df.where("false")).count() == 0
    assert linkrank.filter_urls(df, (), ()).where("verdict <> 'unknown'").count() == 0
