"""Media columns: TIFF.

pages() walks the image directories of a TIFF file (either byte order, classic or big, SubIFDs aside), decodes strips
and tiles (uncompressed, PackBits, LZW, deflate), undoes predictors (2 horizontal, 3 floating point) and gives one row per
page. Samples of 8, 16, 32 and 64 bits are decoded; of fewer than 8 bits, the packed rows are given, each from a byte of its own.

Strips and tiles are decoded a few rows at a time into the page, and no decoder makes more than the page has room for, so a
page takes its own bytes and STEP. A page that claims over max_page bytes (a parameter; MAX_PAGE is what one row of
Spark can hold with room to spare) has an error instead.

Defined results: a page that can't be decoded has its error and NULL pixels; a file whose header or chain of directories is
broken gives a row for each page before the break and one with the error; a directory that was already seen ends the chain;
NULL bytes give no row; an empty file gives one row with an error. Rows that repeat, and NULL keys, give their pages each time; an
empty table gives an empty one. Other columns of the table, whatever their names, aren't read; a key named like a column of
the result is given as key_ and that name.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratemill.llm.common import in_arrow

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_FORMATS = {1: "u", 2: "i", 3: "f"}
COMPRESSIONS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
#: Bytes of a page beyond which it isn't decoded.
MAX_PAGE = 1 << 30
#: Bytes that a decoder makes at once.
STEP = 1 << 20


def unpackbits(data: bytes, need: int | None = None) -> bytes:
    return b"".join(_unpacked(data, need))


def _unpacked(data: bytes, need: int | None = None) -> Iterator[bytes]:
    """PackBits, in parts of about STEP bytes, until there are need bytes."""
    out, i, n, size = [], 0, len(data), 0
    left = math.inf if need is None else need
    while i < n and left > size:
        c = data[i]
        i += 1
        if c < 128:
            out.append(bytes(data[i : i + c + 1]))
            i += c + 1
        elif c > 128:
            out.append(bytes(data[i : i + 1]) * (257 - c))
            i += 1
        size += len(out[-1]) if c != 128 else 0
        if size >= STEP:
            yield b"".join(out)
            left -= size
            out, size = [], 0
    yield b"".join(out)


#: Bits of the codes that follow a clear code, and where each begins: a code gets wider one entry early.
_WIDTHS = np.array([9, 9, *[9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12 for n in range(260, 260 + 8190)]])
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def unlzw(data: bytes, need: int | None = None) -> bytes:
    return b"".join(_unlzw(data, need))


def _unlzw(data: bytes, need: int | None = None) -> Iterator[bytes]:
    """LZW, the high bit first, in parts of about STEP bytes, until there are need bytes. How wide a code is depends on how many
    came since the last clear code, so all up to the next are cut out at once."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, size = list(first), [], 0
    left = math.inf if need is None else need
    at, bits, k, last = 0, 8 * len(data), 0, None
    while size < left:
        n = min(int(np.searchsorted(_STARTS, bits - at + _STARTS[k], "right")) - 1 - k, 4096)
        if n <= 0:
            break
        place = at + _STARTS[k : k + n] - _STARTS[k]
        byte = place >> 3
        word = raw[byte].astype(np.uint32) << 24 | raw[byte + 1].astype(np.uint32) << 16 | raw[byte + 2].astype(np.uint32) << 8 | raw[byte + 3]
        width = _WIDTHS[k : k + n]
        codes = word >> (32 - (place & 7) - width).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        end = int(marks[0]) if len(marks) else n
        for code in codes[:end].tolist():
            if last is None:
                if code > 255:
                    raise ValueError("LZW: the first code is no byte")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW: a code from the future")
                if len(table) < 4096:
                    table.append(last + entry[:1])
            out.append(entry)
            size += len(entry)
            last = entry
            if size >= STEP:
                yield b"".join(out)
                left -= size
                out, size = [], 0
                if left <= 0:
                    return
        if len(marks):
            if codes[end] == 257:
                break
            at += int(_STARTS[k + end + 1] - _STARTS[k])
            table, k, last = list(first), 0, None
        else:
            at += int(_STARTS[k + n] - _STARTS[k])
            k = min(k + n, 4096)  # from there on all are alike
    yield b"".join(out)


def _inflated(data: bytes, need: int) -> Iterator[bytes]:
    engine = zlib.decompressobj()
    while need > 0:
        part = engine.decompress(data, min(need, STEP))
        if not part:
            return
        yield part
        need -= len(part)
        data = engine.unconsumed_tail


def _rows(data: bytes, packing: str, row: int, lines: int) -> Iterator[np.ndarray]:
    """The rows of a strip or tile, some at a time."""
    need = row * lines
    if packing == "none":
        parts = (data[i : i + STEP] for i in range(0, min(need, len(data)), STEP))
    else:
        parts = {"packbits": _unpacked, "lzw": _unlzw, "deflate": _inflated}[packing](data, need)
    held = b""
    for part in parts:
        held = part if not held else b"".join((held, part))
        n = min(len(held) // row, lines)
        if n:
            yield np.frombuffer(held, np.uint8, n * row).reshape(n, row)
            held, lines = bytes(held[n * row :]), lines - n
        if not lines:
            return
    raise ValueError("a strip or tile is too short")


class _File:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise ValueError("no TIFF header")
        self.order = "<" if data[:2] == b"II" else ">"
        magic = self.read("H", 2)
        if magic == 42:
            self.big, self.first = False, self.read("I", 4)
        elif magic == 43 and self.read("H", 4) == 8:
            self.big, self.first = True, self.read("Q", 8)
        else:
            raise ValueError("no TIFF header")

    def read(self, letter: str, at: int):
        return struct.unpack_from(self.order + letter, self.data, at)[0]

    def directory(self, at: int) -> tuple[dict[int, list], int]:
        """Tags of the directory at a place, and the place of the next."""
        n, body, size = (self.read("Q", at), at + 8, 20) if self.big else (self.read("H", at), at + 2, 12)
        if body + n * size > len(self.data):
            raise ValueError("a directory ends beyond the file")
        tags: dict[int, list] = {}
        for k in range(n):
            e = body + k * size
            tag, kind = self.read("H", e), self.read("H", e + 2)
            count = self.read("Q" if self.big else "I", e + 4)
            room, value = (8, e + 12) if self.big else (4, e + 8)
            total = _SIZES.get(kind, 0) * count
            if kind not in _LETTERS or not total:
                continue
            where = value if total <= room else self.read("Q" if self.big else "I", value)
            if where + total > len(self.data):
                raise ValueError(f"tag {tag} ends beyond the file")
            tags[tag] = list(struct.unpack_from(f"{self.order}{count}{_LETTERS[kind]}", self.data, where))
        end = body + n * size
        return tags, self.read("Q" if self.big else "I", end)

    def pixels(self, tags: dict[int, list], max_page: int) -> tuple[np.ndarray, dict]:
        one = lambda tag, other: tags.get(tag, [other])[0]
        width, height = one(256, 0), one(257, 0)
        samples = one(277, 1)
        bits = tags.get(258, [1])
        kind, packing, predictor = one(339, 1), one(259, 1), one(317, 1)
        planar = one(284, 1) == 2 and samples > 1
        if len(set(bits)) != 1:
            raise ValueError("samples of different widths")
        depth = bits[0]
        if not width or not height or not samples:
            raise ValueError("a page without size")
        if packing not in COMPRESSIONS:
            raise ValueError(f"compression {packing} is not decoded")
        if depth not in (8, 16, 32, 64) and not 0 < depth < 8:
            raise ValueError(f"samples of {depth} bits are not decoded")
        per, planes = (1, samples) if planar else (samples, 1)
        tiled = 322 in tags
        tw, th = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height) or height, height))
        row, wide = -(-tw * per * depth // 8), -(-width * per * depth // 8)
        if max(wide * height * planes, row if tw and th else 0, row * th if tiled else 0) > max_page:
            raise ValueError(f"the page has over {max_page} bytes")
        if not tw or not th:
            raise ValueError("a tile without size")
        offsets, counts = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
        across, down = -(-width // tw), -(-height // th)
        if not offsets or not counts or len(offsets) < across * down * planes or len(counts) < across * down * planes:
            raise ValueError("strips or tiles are missing")
        name, size = COMPRESSIONS[packing], max(depth // 8, 1)
        # narrow samples: planes one after the other; their tiles are put together bit by bit
        loose = depth < 8 and across > 1
        whole = np.zeros((planes, height, width * per * depth if loose else wide) if depth < 8 else (height, width, samples, size), np.uint8)
        for k in range(across * down * planes):
            plane, cell = divmod(k, across * down)
            y, x = divmod(cell, across)
            lines = th if tiled else min(th, height - y * th)
            if offsets[k] + counts[k] > len(self.data):
                raise ValueError("a strip or tile ends beyond the file")
            top = y * th
            for raw in _rows(self.data[offsets[k] : offsets[k] + counts[k]], name, row, lines):
                block = self.predicted(raw, predictor, per, depth, kind, tw)[: max(0, height - top)]
                to = slice(top, top + len(block))
                if depth >= 8:
                    cells = block.reshape(len(block), tw, per, size)[:, : width - x * tw]
                    whole[to, x * tw : (x + 1) * tw, plane : plane + 1 if planar else None] = cells
                elif loose:
                    left = x * tw * per * depth
                    whole[plane, to, left : left + tw * per * depth] = np.unpackbits(block, axis=1)[:, : min(tw * per * depth, whole.shape[2] - left)]
                else:
                    whole[plane, to] = block[:, :wide]
                top += len(raw)
        if loose:
            whole = np.packbits(whole, axis=2)
        info = {"width": width, "height": height, "samples": samples, "bits": depth, "sample_format": _FORMATS.get(kind, "u"), "compression": name, "predictor": predictor, "layout": "tiles" if tiled else "strips"}
        return whole.reshape(-1), info

    def predicted(self, block: np.ndarray, predictor: int, per: int, depth: int, kind: int, width: int) -> np.ndarray:
        """Rows in little-endian bytes with the predictor undone."""
        if depth < 8:
            if predictor == 1:
                return block
            if predictor != 2:
                raise ValueError(f"predictor {predictor} is not undone over samples of {depth} bits")
            places = np.arange(depth - 1, -1, -1, dtype=np.uint8)
            bits = np.unpackbits(block, axis=1)[:, : width * per * depth].reshape(len(block), width, per, depth)
            values = np.cumsum((bits << places).sum(axis=3, dtype=np.uint8), axis=1, dtype=np.uint8)
            return np.packbits((values[..., None] >> places & 1).reshape(len(block), -1), axis=1)
        size = depth // 8
        if predictor == 3:
            if kind != 3:
                raise ValueError("a floating-point predictor over other samples")
            planes = np.cumsum(block.reshape(len(block), -1, per), axis=1, dtype=np.uint8).reshape(len(block), size, width * per)
            return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(len(block), -1)
        values = block.reshape(-1).view(f"{self.order}u{size}").astype(f"<u{size}").reshape(len(block), width, per)
        if predictor == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not undone")
        return np.ascontiguousarray(values).view(np.uint8).reshape(len(block), -1)


_NONE = dict.fromkeys(("width", "height", "samples", "bits", "sample_format", "compression", "predictor", "layout", "pixels"))


def pages(data: bytes, max_page: int = MAX_PAGE) -> Iterator[dict]:
    """A row for each page: its number, size, samples, how it was packed, its pixels in little-endian rows, and error."""
    seen: set[int] = set()
    number = 0
    try:
        file = _File(data)
        at = file.first
        while at and at not in seen:
            seen.add(at)
            tags, at = file.directory(at)
            try:
                pixels, info = file.pixels(tags, max_page)
                yield {"page": number, **info, "pixels": pixels.data, "error": None}
            except (ValueError, struct.error, zlib.error, IndexError) as e:
                yield {"page": number, **_NONE, "error": str(e)}
            number += 1
        if not number:
            yield {"page": 0, **_NONE, "error": "a file without pages"}
    except (ValueError, struct.error, IndexError) as e:
        yield {"page": number, **_NONE, "error": str(e)}


_OUT = "page int, width int, height int, samples int, bits int, sample_format string, compression string, predictor int, layout string, pixels binary, error string"


def decode(files: DataFrame, key: str, column: str, max_page: int = MAX_PAGE) -> DataFrame:
    """key and one row for each page of the TIFF files in column."""
    slim = files.select(files[key].alias("key"), files[column].alias("data"))
    schema = f"key {slim.schema['key'].dataType.simpleString()}, {_OUT}"
    kinds = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "samples": pa.int32(), "bits": pa.int32(), "sample_format": pa.string(), "compression": pa.string(), "predictor": pa.int32(), "layout": pa.string(), "pixels": pa.binary(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, size = [], [], 0
            for k, data in zip(batch.column("key"), batch.column("data")):
                if not data.is_valid:
                    continue
                for row in pages(memoryview(data.as_buffer()).cast("B"), max_page):
                    more = 0 if row["pixels"] is None else len(row["pixels"])
                    if rows and size + more > 8 << 20:
                        yield _batch(keys, rows, kinds, batch.schema.field("key").type)
                        keys, rows, size = [], [], 0
                    keys.append(k)
                    rows.append(row)
                    size += more
                    if size > 8 << 20:
                        yield _batch(keys, rows, kinds, batch.schema.field("key").type)
                        keys, rows, size = [], [], 0
            if rows:
                yield _batch(keys, rows, kinds, batch.schema.field("key").type)

    return in_arrow(slim, run, schema).withColumnRenamed("key", f"key_{key}" if key.lower() in kinds else key)


def _batch(keys: list, rows: list[dict], kinds: dict[str, pa.DataType], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([k.as_py() for k in keys], kind)]
    for c, t in kinds.items():
        if c != "pixels":
            columns.append(pa.array([r[c] for r in rows], t))
            continue
        parts = [r[c] if r[c] is not None else b"" for r in rows]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        there = pa.array([r[c] is not None for r in rows])
        whole = parts[0] if len(parts) == 1 else b"".join(parts)  # a large page is alone and isn't copied
        columns.append(pa.Array.from_buffers(t, len(rows), [there.buffers()[1], pa.py_buffer(at), pa.py_buffer(whole)]))
    return pa.RecordBatch.from_arrays(columns, names=["key", *kinds])
