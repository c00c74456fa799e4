"""Word shingles of whole texts as 48-bit hashes, by array operations over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BITS = 48
MASK = U((1 << BITS) - 1)
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, PIECE + 4096), U(base))
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string column without nulls."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _word_hashes(raw: np.ndarray, starts_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words start, their hashes); starts_doc marks bytes at which a text starts."""
    blank = _BLANK[raw]
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | starts_doc[1:]
    begin = np.flatnonzero(first)
    last = word
    last[:-1] &= blank[1:] | starts_doc[1:]
    end = np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + U(1)) * _power(_P, len(raw))[:len(raw)], out=total[1:])
        h = (total[end] - total[begin]) * _power(_P_INV, len(raw) + 1)[begin]
    return begin, mix(h)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, in order; number of words of each text), in pieces of bounded size."""
    n, at, begins, hashes = len(raw), 0, [], []
    mark = np.zeros(n + 1, bool)
    mark[offsets[:-1]] = True
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not mark[end] and not _BLANK[raw[end]]:
            end += 1
        b, h = _word_hashes(raw[at:end], mark[at:end])
        begins.append(b + at)
        hashes.append(h)
        at = end
    begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return hashes, np.diff(np.searchsorted(begins, offsets))


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes of each text's distinct shingles, ascending; n + 1 offsets) of up to 65,536 texts.

    With fewer words than size, all words are one shingle; without words there is none.
    """
    w, n = words_of(*text_bytes(column))
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        if len(w) >= size:
            h = w[:len(w) - size + 1].copy()
            for k in range(1, size):
                h = mix(h, k) + w[k:len(w) - size + 1 + k]
            ok = doc[:len(h)] == doc[size - 1:]
            h, doc = h[ok], doc[:len(h)][ok]
        else:
            h, doc = np.zeros(0, np.uint64), doc[:0]
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            s = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                more = n[short] > k
                s[more] = mix(s[more], size + k) + w[first[short[more]] + k]
            h, doc = np.concatenate([h, mix(s, 99)]), np.concatenate([doc, short])
    key = np.unique((mix(h, 7) & MASK) | (doc.astype(np.uint64) << U(BITS)))
    return key & MASK, np.searchsorted(key >> U(BITS), np.arange(len(n) + 1, dtype=np.uint64))


def pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending uint64 as differences: 4 bytes each where they fit, else 8; the first byte says which."""
    d = np.diff(x, prepend=U(0))
    small = not len(d) or (len(d) > 1 and int(d[1:].max()) < 1 << 32) or len(d) == 1
    if small:
        return b"\x04" + x[:1].astype("<u8").tobytes() + d[1:].astype("<u4").tobytes()
    return b"\x08" + x.astype("<u8").tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x08":
        return np.frombuffer(raw, "<u8", offset=1)
    if len(raw) == 1:
        return np.zeros(0, np.uint64)
    d = np.frombuffer(raw, "<u4", offset=9).astype(np.uint64)
    return np.concatenate([np.frombuffer(raw, "<u8", 1, 1), d]).cumsum(dtype=np.uint64)


def by_part(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, after the last) of ascending 48-bit keys, dealt to 2**bits ranges."""
    part = (keys >> U(BITS - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return part[first], first, np.r_[first[1:], len(part)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of equal, sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])
