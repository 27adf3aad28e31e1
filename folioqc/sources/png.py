"""PNG images in NumPy: eight-bit, non-interlaced, grey, RGB, palette, with or without alpha."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGE = "height int, width int, content binary"


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """A grey (height, width) or RGB (height, width, 3) image of bytes."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + w * (1 if image.ndim == 2 else 3)), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The image as RGB (height, width, 3); alpha is dropped. Other kinds are a ValueError."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, body, palette, head = len(SIGNATURE), b"", None, None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("only eight-bit images without interlace are read")
    w, h, n = head[0], head[1], SAMPLES[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.uint8)
    if not raw[:, 0].any():
        out = raw[:, 1:]
    for y in range(h) if raw[:, 0].any() else ():
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, n)
    pixels = out.reshape(h, w, n)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if n < 3 else pixels[..., :3]


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(row) + n, np.int32)
    up = np.concatenate([np.zeros(n, np.int32), above.astype(np.int32)])
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (int(row[i - n]) + guess) & 255
    return out[n:].astype(np.uint8)


def page_images(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width, content (RGB bytes) of PNG files (keys, content); others give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            images = []
            for data in pdf["content"]:
                try:
                    image = decode(bytes(data))
                    images.append((*image.shape[:2], image.tobytes()))
                except (ValueError, TypeError, IndexError, struct.error, zlib.error):
                    images.append((None, None, None))
            out[["height", "width", "content"]] = pd.DataFrame(images, index=out.index, columns=["height", "width", "content"], dtype=object)
            yield out

    types = dict(files.dtypes)
    return files.select(*keys, "content").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + IMAGE)
