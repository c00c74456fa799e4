"""Suffix sorting by grouping, in linear time and without recursive renaming.

First, suffixes are grouped by their longest Lyndon prefix: groups start as the first symbols,
and are taken in descending order; every suffix of a group points to the nearest suffix before
it that is in a smaller group (previous-smaller pointer), and suffixes so pointed at leave
their group for one right behind it, by how many pointers they got. Then suffixes are emitted
in ascending order: one that is placed places the one before it at the front of its group, and
all that the pointers of that one lead to.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of all suffixes in order; the last symbol has to be smaller than all others."""
    n = len(text)
    if not n:
        return []
    sa_ = np.argsort(text, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(text[sa_]) != 0])
    sizes = np.diff(np.r_[firsts, n])
    of = np.empty(n, np.int64)
    of[sa_] = np.repeat(firsts, sizes)
    place = np.empty(n, np.int64)
    place[sa_] = np.arange(n)
    size_ = np.zeros(n, np.int64)
    size_[firsts] = sizes
    sa, group, at, size, prev = sa_.tolist(), of.tolist(), place.tolist(), size_.tolist(), [-1] * n
    end = n - 1
    while end > 0:
        top = group[sa[end]]
        if top == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and group[p] > top:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:
                    last, here = g + k - 1, at[p]
                    if here != last:
                        q = sa[last]
                        sa[here], sa[last], at[q], at[p] = q, p, here, last
                    size[g], size[last], group[p] = k - 1, 1, last
            end -= 1
            continue
        points: dict[int, int] = {}
        for s in sorted(sa[top:end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= top:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        end = top - 1
        if not points:
            continue
        counts = sorted(set(points.values()), reverse=True)
        for c in counts:
            left: dict[int, list[int]] = {}
            for p in points if len(counts) == 1 else [p for p, k in points.items() if k == c]:
                g = group[p]
                if g in left:
                    left[g].append(p)
                else:
                    left[g] = [p]
            for g, gone in left.items():
                k = size[g]
                if len(gone) == k:
                    continue
                last = g + k
                for p in gone:
                    last -= 1
                    here = at[p]
                    if here != last:
                        q = sa[last]
                        sa[here], sa[last], at[q], at[p] = q, p, here, last
                size[g], size[last] = last - g, len(gone)
                for p in gone:
                    group[p] = last
    out, front, placed = [-1] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = prev[s]
    return out
