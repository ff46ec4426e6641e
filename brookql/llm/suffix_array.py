"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes in text order, and search across shards."""

from __future__ import annotations

import numpy as np

U = np.uint64


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    n = len(data)
    w = padded[:n].copy()
    for k in range(1, 8):
        w <<= U(8)
        w |= padded[k : n + k]
    return w


def suffix_array(data: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Starts of the suffixes in order, or in order of (at least) their first ``limit`` bytes.

    Suffixes are put in order of eight bytes at first; then, doubling the width, only groups of more than one are sorted on, by the
    rank of what follows (a rank is the first place of a group, so finished groups keep theirs).
    """
    n = len(data)
    first = words8(data)
    sa = np.argsort(first, kind="stable").astype(np.int64)
    ordered = first[sa]
    start = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(start, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = group, -1
    width = 8
    while limit is None or width < limit:
        alone = start & np.r_[start[1:], True]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = sa[open_]
        behind = at + width
        # what ends before is less than what goes on, and the less the earlier it ends (zeros stand past the end)
        follow = np.where(behind < n, rank[np.minimum(behind, n)] + width + 1, width - (behind - n))
        key = (rank[at].astype(U) << U(32)) | follow.astype(U)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[open_] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        start[open_] = fresh
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        width *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in a full ``sa`` has in common with the one before it (0 for the first), in the order of ``sa``.

    As in Kasai's method, a suffix shares at least one byte less than the suffix one place earlier in the text.  Where the bytes
    before both are equal it is exactly one less; only the other places are compared, all at once.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    compare = (before < 0) | (i == 0) | (before == 0)
    compare |= data[i - 1] != data[before - 1]
    at = np.flatnonzero(compare & (before >= 0))
    other, same = before[at], np.zeros(n, np.int64)
    eight, more = words8(data), at
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        a, b = more[live] + length[live], other[live] + length[live]
        inside = np.maximum(a, b) + 8 <= n
        equal = inside & (eight[np.minimum(a, n - 1)] == eight[np.minimum(b, n - 1)])
        rest = live[~equal]
        a, b = a[~equal], b[~equal]
        going = np.ones(len(rest), bool)
        for _ in range(8):
            going &= (np.maximum(a, b) < n) & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
            length[rest] += going
            a, b = a + 1, b + 1
        length[live[equal]] += 8
        live = live[equal]
    same[at] = length
    reach = np.where(compare, same + i, 0)
    in_text = np.maximum(np.maximum.accumulate(reach) - i, 0)
    in_text[before < 0] = 0
    return in_text[sa]


def find(data: np.ndarray, sa: np.ndarray, pattern_data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges [low, high) of ``sa`` whose suffixes begin with the ``size`` bytes of ``pattern_data`` from each place ``at``."""
    steps = range(0, size, 8)
    mine, theirs = words8(pattern_data), words8(data)
    n = len(data)

    def less(places: np.ndarray, wanted: np.ndarray, or_equal: bool) -> np.ndarray:
        out, tied = np.zeros(len(places), bool), np.ones(len(places), bool)
        for k in steps:
            s = places + k
            a = np.where(s < n, theirs[np.minimum(s, n - 1)], U(0))
            b = mine[np.minimum(wanted + k, len(mine) - 1)]
            if size - k < 8:
                cut = U(8 * (8 - (size - k)))
                a, b = a >> cut, b >> cut
            out |= tied & (a < b)
            tied &= a == b
            if not tied.any():
                break
        return out | tied if or_equal else out

    ends = []
    for or_equal in (False, True):
        low, high = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            go = np.zeros(len(at), bool)
            go[open_] = less(sa[mid[open_]], at[open_], or_equal)
            low, high = np.where(open_ & go, mid + 1, low), np.where(open_ & ~go, mid, high)
        ends.append(low)
    low, high = ends
    while (short := (low < high) & (sa[np.minimum(low, n - 1)] + size > n)).any():  # zeros that stand past the end aren't bytes
        low = low + short
    return low, high
