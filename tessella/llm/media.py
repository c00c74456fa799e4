"""Media columns: AVI motion-JPEG bytes from and to rows, and shots as timed clips.

A payload is stored as grey baseline JPEG frames of 16 x 12 blocks: each byte is one 8 x 8
block of that grey, so that the only coefficient is the DC one, quantised by 8, and nothing is
lost. The Huffman tables give a DC difference of category s a code of 9 - s bits, so that code
and difference bits take 9 bits together and a block with its end-of-block bit takes 10; whole
batches of frames are coded and decoded at once. Frames stand in a RIFF AVI with an idx1 index.

Reading parses the RIFF tree, takes frames by the index, and decodes them: baseline JPEG with
any Huffman and quantisation tables, DC and AC coefficients, inverse DCT, one to four components
with any sampling, restart markers. Frames whose header is ours, in which all codes take ten
bits, are decoded many at once. Shots end where the grey histogram changes more than it did over
the last frames. Frames are coded, written, read back and hashed in blocks of BLOCK, so that
only the media bytes of a text are held as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

COLS, ROWS = 16, 12
FRAME = COLS * ROWS  # samples a frame
FPS = 25
BITS = 10  # of a coded block
CODED = FRAME * BITS // 8
BLOCK = 2048  # frames that are coded at once

#: Grey bins of a histogram; frames, samples and factor of the adaptive cut.
BINS, MEMORY, FLOOR, FACTOR = 16, 8, 48, 2


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.lru_cache(maxsize=1)
def frame_header() -> bytes:
    """SOI to SOS of every frame we write."""
    dqt = _segment(0xDB, b"\x00" + bytes([8]) + bytes([1] * 63))
    sof = _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLS * 8, 1) + b"\x01\x11\x00")
    dc = _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    return b"\xff\xd8" + dqt + sof + dc + ac + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


@functools.lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """(10 bits of each difference -255..255, difference of each 9 bits)."""
    coded, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        prefix = ((1 << (9 - s)) - 2) if s < 9 else 0  # category s: 8 - s ones and a zero, 9 - s bits
        word = (prefix << s) | extra
        coded[d + 255], back[word] = word << 1, d
    return coded, back


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG bytes of frames (n, FRAME) of uint8: (all bytes one after the other, length of each)."""
    n = len(samples)
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128))
    w = _codes()[0][diff + 255].astype(np.uint64).reshape(n, -1, 4)
    w = (w[:, :, 0] << np.uint64(30)) | (w[:, :, 1] << np.uint64(20)) | (w[:, :, 2] << np.uint64(10)) | w[:, :, 3]
    raw = w.astype(">u8").view(np.uint8).reshape(n, -1, 8)[:, :, 3:].reshape(n, CODED)
    head, tail = np.frombuffer(frame_header(), np.uint8), np.frombuffer(b"\xff\xd9", np.uint8)
    whole = np.empty((n, len(head) + CODED + 2), np.uint8)
    whole[:, :len(head)], whole[:, len(head):-2], whole[:, -2:] = head, raw, tail
    stuff = np.zeros(whole.shape, np.int64)
    stuff[:, len(head):-2] = raw == 0xFF
    reps = (stuff + 1).ravel()
    out = np.repeat(whole.ravel(), reps)
    at = np.cumsum(reps) - 1
    out[at[stuff.ravel() == 1]] = 0
    return out, whole.shape[1] + stuff.sum(axis=1)


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples (n, FRAME) of JPEG frames at starts of data: block means of each."""
    head = np.frombuffer(frame_header(), np.uint8)
    k = len(head)
    ours = len(starts) > 0 and bool((sizes >= k + CODED + 2).all()) and bool((data[starts[:, None] + np.arange(k)] == head).all())
    if not ours:
        return np.stack([decode_grey(data[a:a + s].tobytes()) for a, s in zip(starts, sizes)]) if len(starts) else np.zeros((0, FRAME), np.uint8)
    n = sizes - k - 2
    first = np.cumsum(n) - n
    flat = data[np.arange(n.sum()) + np.repeat(starts + k - first, n)]
    after = np.zeros(len(flat), bool)
    after[1:] = flat[:-1] == 0xFF
    after[first] = False
    raw = flat[~(after & (flat == 0))].reshape(-1, 5).astype(np.uint64)
    w = (raw[:, 0] << np.uint64(32)) | (raw[:, 1] << np.uint64(24)) | (raw[:, 2] << np.uint64(16)) | (raw[:, 3] << np.uint64(8)) | raw[:, 4]
    words = np.stack([(w >> np.uint64(s)) & np.uint64(0x3FF) for s in (30, 20, 10, 0)], axis=1).astype(np.int64)
    diff = _codes()[1][words.ravel() >> 1].reshape(-1, FRAME)
    return (np.cumsum(diff, axis=1) + 128).astype(np.uint8)


#: The zigzag order of a block's coefficients, by rows.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)


@functools.lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """basis[x, u] of the inverse 8-point DCT."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


class _Bits:
    """Huffman symbols and numbers of one restart interval."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code * 2 + self.bits[self.at]
            self.at += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        """A signed number of size bits."""
        v = 0
        for _ in range(size):
            v = v * 2 + self.bits[self.at]
            self.at += 1
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _tables(jpeg: bytes) -> tuple[dict, dict, dict, int]:
    """(Huffman tables, quantisation tables, frame, start of the scan's data) of a baseline JPEG."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, huffman, quant, frame = 2, {}, {}, {"restart": 0}
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2:at + 4], "big")
        body, at = jpeg[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65:]
        elif marker == 0xC4:
            while body:
                counts, symbols, code, table = body[1:17], iter(body[17:17 + sum(body[1:17])]), 0, {}
                for bits, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[bits, code] = next(symbols)
                        code += 1
                    code <<= 1
                huffman[body[0]] = table
                body = body[17 + sum(counts):]
        elif marker == 0xDD:
            frame["restart"] = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [body[6 + 3 * k:9 + 3 * k] for k in range(n)]
            frame.update(height=height, width=width, parts={p[0]: (p[1] >> 4, p[1] & 15, p[2]) for p in parts})
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("no baseline JPEG")
        elif marker == 0xDA:
            frame["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, 0x10 | (body[2 + 2 * k] & 15)) for k in range(body[0])]
            return huffman, quant, frame, at


def decode_jpeg(jpeg: bytes) -> list[np.ndarray]:
    """Planes (one a component, in the frame's size) of a baseline JPEG with one interleaved scan."""
    huffman, quant, frame, at = _tables(jpeg)
    end = jpeg.rindex(b"\xff\xd9")
    pieces, start, i = [], at, at
    while (i := jpeg.find(b"\xff", i, end)) >= 0:  # restart markers part the data
        if 0xD0 <= jpeg[i + 1] <= 0xD7:
            pieces.append(jpeg[start:i])
            start = i + 2
        i += 2
    pieces.append(jpeg[start:end])
    parts, height, width = frame["parts"], frame["height"], frame["width"]
    most_h, most_v = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    if len(parts) == 1:  # a single component is not interleaved: its blocks are units
        (name, (_, _, q)), = parts.items()
        parts, most_h, most_v = {name: (1, 1, q)}, 1, 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    coded = {name: np.zeros((down * v, across * h, 64)) for name, (h, v, _) in parts.items()}
    units, each = across * down, frame["restart"] or across * down
    for k, raw in enumerate(pieces):
        bits, last = _Bits(raw), dict.fromkeys(parts, 0)
        for unit in range(k * each, min(units, (k + 1) * each)):
            row, column = divmod(unit, across)
            for name, dc, ac in frame["scan"]:
                h, v, _ = parts[name]
                for y in range(v):
                    for x in range(h):
                        block = coded[name][row * v + y, column * h + x]
                        last[name] += bits.number(bits.symbol(huffman[dc]))
                        block[0], i = last[name], 1
                        while i < 64:
                            rs = bits.symbol(huffman[ac])
                            if rs & 15 == 0 and rs != 0xF0:
                                break
                            i += rs >> 4
                            block[ZIGZAG[i]] = bits.number(rs & 15)
                            i += 1
    planes, basis = [], _cosines()
    for name, (h, v, q) in parts.items():
        scale = np.zeros(64)
        scale[list(ZIGZAG)] = quant[q]
        blocks = (coded[name] * scale).reshape(*coded[name].shape[:2], 8, 8)
        samples = np.clip(np.rint(basis @ blocks @ basis.T + 128), 0, 255).astype(np.uint8)
        plane = samples.transpose(0, 2, 1, 3).reshape(samples.shape[0] * 8, -1)
        planes.append(plane.repeat(most_v // v, axis=0).repeat(most_h // h, axis=1)[:height, :width])
    return planes


def decode_grey(jpeg: bytes) -> np.ndarray:
    """Block means (row by row) of the first plane of any baseline JPEG frame: the general, slow way."""
    plane = decode_jpeg(jpeg)[0].astype(np.float64)
    high, wide = (-(-n // 8) for n in plane.shape)
    plane = np.pad(plane, ((0, high * 8 - plane.shape[0]), (0, wide * 8 - plane.shape[1])), mode="edge")
    return np.rint(plane.reshape(high, 8, wide, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


class AviWriter:
    """A RIFF AVI of MJPG frames, grown block by block; its heads are filled in at the end."""

    def __init__(self):
        self.out, self.index, self.most = bytearray(self._head(0, 0)), [], 0
        self.movi = len(self.out) - 4

    def _head(self, n: int, movi: int, index: int = 0) -> bytes:
        """All before the first frame, for n frames in a movi list of that size."""
        w, h = COLS * 8, ROWS * 8
        most = self.most if n else 0
        avih = struct.pack("<14I", 1_000_000 // FPS, min(most * FPS, 0xFFFFFFFF), 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
        strh = b"vidsMJPG" + struct.pack("<3I", 0, 0, 0) + struct.pack("<7I", 1, FPS, 0, n, most, 0xFFFFFFFF, 0) + struct.pack("<4h", 0, 0, w, h)
        strf = struct.pack("<IiiHH4s5I", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
        hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
        return b"RIFF" + struct.pack("<I", 4 + len(hdrl) + 12 + movi + index) + b"AVI " + hdrl + b"LIST" + struct.pack("<I", movi + 4) + b"movi"

    def add(self, jpegs: np.ndarray, sizes: np.ndarray) -> None:
        """Frames that stand one after the other in jpegs."""
        n, padded = len(sizes), sizes + sizes % 2
        at = np.cumsum(padded + 8) - padded - 8  # of the chunk heads in this block
        block = np.zeros(int((padded + 8).sum()), np.uint8)
        heads = np.zeros((n, 8), np.uint8)
        heads[:, :4] = np.frombuffer(b"00dc", np.uint8)
        heads[:, 4:] = sizes.astype("<u4").view(np.uint8).reshape(n, 4)
        block[at[:, None] + np.arange(8)] = heads
        first = np.cumsum(sizes) - sizes
        block[np.arange(len(jpegs)) + np.repeat(at + 8 - first, sizes)] = jpegs
        index = np.zeros((n, 4), "<u4")
        index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, at + len(self.out) - self.movi, sizes
        self.index.append(index.tobytes())
        self.out += block.data
        self.most = max(self.most, int(sizes.max(initial=0)))

    def finish(self) -> bytearray:
        movi, index = len(self.out) - self.movi - 4, _chunk(b"idx1", b"".join(self.index))
        head = self._head(len(index) // 16, movi, len(index))
        self.out[:len(head)] = head
        self.out += index
        return self.out


def write_avi(jpegs: np.ndarray, sizes: np.ndarray) -> bytes:
    """A RIFF AVI of MJPG frames that stand one after the other in jpegs."""
    w = AviWriter()
    w.add(jpegs, sizes)
    return bytes(w.finish())


def read_index(avi: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(where frames start, their sizes, microseconds a frame), by the RIFF tree and its idx1.

    Offsets of the index count from the movi list, or, as some writers have it, from the file's start.
    """
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI")
    at, movi, index, per_frame = 12, None, None, 1_000_000 // FPS
    while at + 8 <= len(avi):
        kind, size = avi[at:at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if kind == b"LIST" and avi[at + 8:at + 12] == b"movi":
            movi = at + 8
        elif kind == b"LIST" and avi[at + 8:at + 12] == b"hdrl":
            per_frame = struct.unpack_from("<I", avi, at + 20)[0]
        elif kind == b"idx1":
            index = np.frombuffer(avi, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    frames = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
    whole_file = len(frames) and avi[movi + frames[0, 2]:movi + frames[0, 2] + 4] != index[0, 0].tobytes()
    return frames[:, 2] + (0 if whole_file else movi) + 8, frames[:, 3], per_frame


def histograms(frames: np.ndarray) -> np.ndarray:
    """Grey histograms of frames, BINS numbers each."""
    n = len(frames)
    return np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)


def cuts(hist: np.ndarray) -> list[tuple[int, int]]:
    """[(first frame, frame after the last)]: a cut where histograms differ by FLOOR samples at
    least and by more than FACTOR times the mean difference of the last MEMORY frames (the first
    transition has none before it, and FLOOR alone decides)."""
    n = len(hist)
    if not n:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)  # d[i]: frame i + 1 against i
    total = np.r_[0, np.cumsum(d)]
    i = np.arange(len(d))
    low = np.maximum(0, i - MEMORY)
    cut = (d >= FLOOR) & ((i == 0) | (d * (i - low) > FACTOR * (total[i] - total[low])))
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """cuts() of decoded frames."""
    return cuts(histograms(frames))


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "replace")
    return len(raw), raw + b" " * ((-len(raw)) % FRAME or (FRAME if not raw else 0))


def to_avi(payload) -> bytearray:
    """The AVI of a payload, coded in blocks."""
    samples, w = np.frombuffer(payload, np.uint8).reshape(-1, FRAME), AviWriter()
    for a in range(0, len(samples), BLOCK):
        w.add(*encode_frames(samples[a:a + BLOCK]))
    return w.finish()


def read_back(avi, use=lambda raw: None) -> tuple[list[dict], int, bytes]:
    """(timed clip rows, payload bytes, the last 16 of them) of an AVI; use() gets the payload block by block."""
    starts, sizes, per_frame = read_index(avi)
    data, hists, sums, n, tail = np.frombuffer(avi, np.uint8), [], [np.zeros(1, np.int64)], 0, b""
    for a in range(0, len(starts), BLOCK):
        frames = decode_frames(data, starts[a:a + BLOCK], sizes[a:a + BLOCK])
        raw = frames.tobytes()
        use(raw)
        n, tail = n + len(raw), raw[-16:]
        hists.append(histograms(frames).astype(np.int32))
        sums.append(frames.sum(axis=1, dtype=np.int64))
    grey = np.cumsum(np.concatenate(sums))
    each = n // max(1, len(starts))
    found = cuts(np.concatenate(hists)) if hists else []
    return [{"clip": k, "first_frame": a, "frames": b - a, "start_ms": a * per_frame // 1000, "end_ms": b * per_frame // 1000, "mean_grey": int((grey[b] - grey[a]) // ((b - a) * each))} for k, (a, b) in enumerate(found)], n, tail


def clips(avi: bytes) -> list[dict]:
    """Timed clip rows of an AVI: frames, milliseconds, mean grey."""
    return read_back(avi)[0]


def stored(text: str | None) -> dict:
    """Everything that one text's row gets; equal texts, equal values."""
    n, payload = payload_of(text or "")
    avi = to_avi(payload)
    del payload
    sha = hashlib.sha256()
    rows, size, tail = read_back(avi, sha.update)
    longest = max(r["frames"] for r in rows)
    table = ";".join(f"{r['first_frame']}+{r['frames']}@{r['mean_grey']}" for r in rows)
    feature = f"frames={size // FRAME} clips={len(rows)} longest={longest} ms={rows[-1]['end_ms']} table={zlib.crc32(table.encode()):08x}"
    return {
        "n_bytes": n, "payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(avi),
        "media_sha256": hashlib.sha256(avi).hexdigest(), "feature": feature, "clips": rows, "media": avi,
    }


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "clips array<struct<clip:int,first_frame:int,frames:int,start_ms:long,end_ms:long,mean_grey:int>>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(doc_id, digests, feature, clips[, media binary]) of every row, whole texts.

    Null and empty texts are one frame of blanks; a null id stays null; repeated rows and equal
    texts (ties) give equal results; of a very long text the media bytes, about twice its own,
    are held at once, and one text of a batch at a time unless the media are kept; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    schema = f"{DIGEST}, {CLIPS}" + ", media binary" * keep_media
    names = [*(c.split()[0] for c in DIGEST.split(", ")), "clips", *["media"] * keep_media]

    def row(text):
        out = stored(text)
        return [bytes(out[c]) if c == "media" else out[c] for c in names]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([row(t) for t in texts], columns=names)
        release()

    made = F.pandas_udf(run, schema)
    return docs.select(F.col(id_col).alias("doc_id"), made(F.col(text_col).cast("string")).alias("m")).select("doc_id", "m.*")


def clip_rows(docs: DataFrame, **options) -> DataFrame:
    """One row for each timed clip of every document's media."""
    return media_columns(docs, **options).select("doc_id", F.inline("clips"))
