"""Content-defined anchors: the places that any two equal windows of bytes have in common.

A window of WINDOW bytes has WINDOW - GRAM + 1 grams; its anchor is the (first) smallest gram
hash. Equal windows have the same anchor at the same distance, so whatever two texts share is
found by comparing, for equal anchor grams, the stretches of text whose windows they anchor.
"""

from __future__ import annotations

import numpy as np

from .shingles import U, _P, _P_INV, _power, mix

WINDOW, GRAM = 50, 26
REACH = WINDOW - GRAM
PIECE = 1 << 20


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best of x[i:i + n], for every i that has so many; by doubling."""
    out, done = x, 1
    while done < n:
        step = min(done, n - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, where its stretch starts in it, length, gram's place in the stretch, gram hash, stretch hash).

    One row for each run of windows with one anchor; the stretch is what those windows cover.
    Runs are cut where pieces of PIECE bytes meet.
    """
    found = [_piece(raw, offsets, at, min(len(raw), at + PIECE)) for at in range(0, max(1, len(raw)), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _piece(raw, offsets, at, end):
    """Anchors of the windows that start in raw[at:end]."""
    b = raw[at:min(len(raw), end + WINDOW)]
    m = len(b)
    ints = np.zeros(0, np.int64)
    if m < WINDOW:
        return ints, ints, ints, ints, ints.astype(np.uint64), ints.astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + U(1)) * _power(_P, m)[:m], out=total[1:])
        back = _power(_P_INV, m + 1)
        h = mix((total[GRAM:] - total[:-GRAM]) * back[:m - GRAM + 1])
    # the place in the low bits: of equal hashes the first is the smallest
    low = U((1 << 21) - 1)
    least = (_sliding((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1, np.minimum) & low).astype(np.int64)[:end - at]
    start = np.arange(len(least))
    doc = np.searchsorted(offsets, at, "right") - 1
    doc = doc + np.cumsum(np.bincount(np.clip(offsets[doc + 1:] - at, 0, len(start)), minlength=len(start) + 1)[:len(start)])
    valid = np.flatnonzero(start + at + WINDOW <= offsets[doc + 1])
    p, doc = least[valid], doc[valid]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]) if len(p) else ints
    last = np.r_[first[1:], len(p)] - 1 if len(p) else ints
    a, z, p, doc = valid[first], valid[last] + WINDOW if len(p) else ints, p[first], doc[first]
    with np.errstate(over="ignore"):
        whole = mix((total[z] - total[a]) * back[a] + mix(((p - a) * 256 + z - a).astype(np.uint64), 9), 8)
    return doc, a + at - offsets[doc], z - a, p - a, h[p], whole
