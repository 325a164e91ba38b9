"""A TIFF writer: test files, and the media column that the tables lack."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratemill.llm.common import in_arrow

CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i
        while j + 1 < n and j - i < 127 and data[j + 1] == data[i]:
            j += 1
        if j > i:
            out += bytes([257 - (j - i + 1), data[i]])
            i = j + 1
            continue
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    codes, width, top = [(256, 9)], 9, 258
    held = b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if held + c in table:
            held += c
            continue
        codes.append((table[held], width))
        table[held + c] = top
        top += 1
        width = 9 if top < 512 else 10 if top < 1024 else 11 if top < 2048 else 12
        if top == 4094:
            codes.append((256, width))
            table, width, top = {bytes([i]): i for i in range(256)}, 9, 258
        held = c
    if held:
        codes.append((table[held], width))
        top += 1
        width = 9 if top < 512 else 10 if top < 1024 else 11 if top < 2048 else 12
    codes.append((257, width))
    value = bits = 0
    for code, w in codes:
        value, bits = value << w | code, bits + w
    pad = -bits % 8
    return (value << pad).to_bytes((bits + pad) // 8, "big")


def _pack(block: np.ndarray, compression: str, predictor: int, order: str) -> bytes:
    """block: rows, columns, samples."""
    size = block.dtype.itemsize
    if predictor == 3:
        raw = block.astype(f">f{size}").reshape(len(block), -1, 1).view(np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1).reshape(len(block), -1, block.shape[2])
        raw = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], 1).astype(np.uint8).tobytes()
    else:
        ints = block.view(f"u{size}")
        if predictor == 2:
            ints = np.concatenate([ints[:, :1], ints[:, 1:] - ints[:, :-1]], 1)
        raw = ints.astype(f"{order}u{size}").tobytes()
    return raw if compression == "none" else packbits(raw) if compression == "packbits" else lzw(raw) if compression == "lzw" else zlib.compress(raw, 1)


def write(images: list[np.ndarray], packing: list[tuple[str, int, tuple[int, int] | int]], order: str = "<", big: bool = False) -> bytes:
    """A file of images (rows, columns, samples). packing: compression, predictor, and rows of a strip or (rows, columns) of a tile."""
    word, size, cell = ("Q", 20, 8) if big else ("I", 12, 4)
    out = bytearray(b"II" if order == "<" else b"MM")
    out += struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16) if big else (42, 8)))
    link = len(out) - cell
    for image, (compression, predictor, shape) in zip(images, packing):
        h, w, s = image.shape
        parts = []
        if isinstance(shape, tuple):
            th, tw = shape
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), image.dtype)
            full[:h, :w] = image
            parts = [_pack(np.ascontiguousarray(full[y : y + th, x : x + tw]), compression, predictor, order) for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [_pack(np.ascontiguousarray(image[y : y + shape]), compression, predictor, order) for y in range(0, h, shape)]
        places = []
        for p in parts:
            places.append(len(out))
            out += p
        kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [image.dtype.itemsize * 8] * s), (259, 3, [CODES[compression]]), (262, 3, [1]), (277, 3, [s]), (317, 3, [predictor]), (339, 3, [kind] * s)]
        lens = [len(p) for p in parts]
        tags += [(322, 4, [shape[1]]), (323, 4, [shape[0]]), (324, 4, places), (325, 4, lens)] if isinstance(shape, tuple) else [(273, 4, places), (278, 4, [shape]), (279, 4, lens)]
        out += b"\0" * (len(out) % 2)
        entries = []
        for tag, t, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{'H' if t == 3 else 'I'}", *values)
            if len(body) > cell:
                at = len(out)
                out += body
                body = struct.pack(order + word, at)
            entries.append(struct.pack(f"{order}HH{word}", tag, t, len(values)) + body.ljust(cell, b"\0"))
        out[link : link + cell] = struct.pack(order + word, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * cell
    return bytes(out)


def of_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id and tiff: each vector as a file of four pages, a float image, its 8-bit and 16-bit renderings and a tiled one. NULL or empty vectors have no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for v in batch.column("embedding").to_pylist():
                x = np.nan_to_num(np.array([0.0 if e is None else e for e in v or []], np.float32))
                if not len(x):
                    files.append(None)
                    continue
                side = next(d for d in range(int(len(x) ** 0.5), 0, -1) if len(x) % d == 0)
                x = x.reshape(side, -1, 1)
                grey = np.clip(np.round(x * 127 + 128), 0, 255).astype(np.uint8)
                deep = np.clip(np.round(x * 32767 + 32768), 0, 65535).astype(np.uint16)
                files.append(write([x, grey, deep, grey], [("lzw", 3, max(1, side // 2)), ("packbits", 1, max(1, side // 2)), ("deflate", 2, (16, 16)), ("lzw", 2, (16, 16))]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(files, pa.binary())], names=["vec_id", "tiff"])

    slim = vectors.select("vec_id", "embedding")
    return in_arrow(slim, run, f"vec_id {slim.schema['vec_id'].dataType.simpleString()}, tiff binary")
