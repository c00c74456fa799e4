"""Images as arrays: PNG in and out, resizing, normalising and packing for vision models."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (mean, deviation) of the channels that models were trained with.
NORMALS = {"siglip": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)), "imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))}
_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def write_png(pixels: np.ndarray) -> bytes:
    """PNG of (rows, columns) or (rows, columns, 1 to 4) bytes, each row coded as it is."""
    p = np.asarray(pixels, np.uint8).reshape(*np.shape(pixels)[:2], -1)
    rows, columns, channels = p.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", columns, rows, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    body = np.concatenate([np.zeros((rows, 1), np.uint8), p.reshape(rows, -1)], axis=1).tobytes()
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """(rows, columns, 3) bytes of an 8-bit PNG that is not interlaced: grey, palette or colour; alpha is dropped."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise ValueError("only 8-bit PNG without interlace is read")
    columns, rows, channels = head[0], head[1], _CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, 1 + columns * channels)
    out, above = np.zeros((rows, columns * channels), np.uint8), np.zeros(columns * channels, np.int64)
    for y, line in enumerate(lines):
        above = _unfiltered(int(line[0]), line[1:].astype(np.int64), above, channels)
        out[y] = above
    pixels = out.reshape(rows, columns, channels)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) % 256
    if kind == 1:  # sums along each channel
        return (np.cumsum(line.reshape(-1, step), axis=0) % 256).ravel()
    out = np.zeros(len(line) + step, np.int64)
    corner = np.r_[np.zeros(step, np.int64), above]
    for i in range(len(line)):
        left, up, diagonal = int(out[i]), int(above[i]), int(corner[i])
        if kind == 3:
            near = (left + up) // 2
        else:
            guess = left + up - diagonal
            near = min((left, up, diagonal), key=lambda v: abs(guess - v))
        out[i + step] = (int(line[i]) + near) % 256
    return out[step:]


def _weights(size: int, to: int) -> np.ndarray:
    """(to, size): how much each old place counts for each new one, by a windowed sinc of three lobes."""
    ratio = size / to
    wide = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bytes at another size; the same size stays as it is."""
    if pixels.shape[:2] == (rows, columns):
        return pixels
    out = np.einsum("yr,rxc->yxc", _weights(pixels.shape[0], rows), pixels.astype(np.float64))
    out = np.einsum("xq,yqc->yxc", _weights(pixels.shape[1], columns), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def channels_first(pixels: np.ndarray, rows: int, columns: int, normal: str = "siglip") -> np.ndarray:
    """(3, rows, columns) of (value / 255 - mean) / deviation."""
    mean, deviation = (np.array(x, np.float32) for x in NORMALS[normal])
    return ((resize(pixels, rows, columns).astype(np.float32) / 255 - mean) / deviation).transpose(2, 0, 1)


def text_lines(images: list[np.ndarray], rows: int, columns: int, normal: str = "siglip") -> np.ndarray:
    """(n, 3, rows, columns): lines at their own aspect ratio, zeros to the right of shorter ones."""
    out = np.zeros((len(images), 3, rows, columns), np.float32)
    for i, p in enumerate(images):
        wide = min(max(-(-rows * p.shape[1] // max(p.shape[0], 1)), 1), max(columns, 1))
        out[i, :, :, :wide] = channels_first(p, rows, wide, normal)
    return out


def patch_mean(rows: np.ndarray) -> np.ndarray:
    """One vector of an image's (patches, dimensions), or of a vector as it is."""
    rows = np.asarray(rows, np.float64)
    if rows.ndim == 1:
        return rows
    if not len(rows):
        raise ValueError("no patches")
    return rows.mean(axis=0)


def decode(image: Column) -> Column:
    """(rows, columns, pixels, error) of PNG bytes; a null image has no pixels and no error."""

    @F.pandas_udf("rows int, columns int, pixels binary, error string")
    def run(files: pd.Series) -> pd.DataFrame:
        out = []
        for f in files:
            try:
                p = None if f is None else read_png(bytes(f))
                out.append((None, None, None, None) if p is None else (p.shape[0], p.shape[1], p.tobytes(), None))
            except (ValueError, zlib.error) as e:
                out.append((None, None, None, str(e)))
        return pd.DataFrame(out, columns=["rows", "columns", "pixels", "error"]).astype({"rows": "Int32", "columns": "Int32"})

    return run(image)


def model_input(image: Column, rows: int, columns: int, normal: str = "siglip") -> Column:
    """The flat (3, rows, columns) tensor of PNG bytes."""

    @F.pandas_udf("array<float>")
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda f: None if f is None else channels_first(read_png(bytes(f)), rows, columns, normal).ravel().tolist())

    return run(image)
