"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search in another array.

Texts are bytes; 0xFF, which UTF-8 never has, parts the pieces of a shard. Order is
settled up to a depth: suffixes that agree that far stay as they are.

Defined cases: no bytes, no suffixes; equal pieces are neighbours.
"""

from __future__ import annotations

import numpy as np

PART = 0xFF


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number; past the end 0xFF."""
    padded = np.concatenate([text, np.full(8, PART, np.uint8)]).astype(np.uint64)
    n = len(text)
    w = padded[:n].copy()
    for k in range(1, 8):
        w <<= np.uint64(8)
        w |= padded[k : k + n]
    return w


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes at least.

    The first sort is by eight bytes. Then, as the compared length doubles, only the groups
    that are still tied are sorted again, by the rank of what follows.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    first = words8(text)
    sa = np.argsort(first, kind="stable")
    s = first[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(at, np.diff(np.append(at, n)))  # a group's rank is its first place
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of two or more
    h = 8
    while h < depth and len(tied):
        pos = sa[tied]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)], n)
        group = rank[pos]
        order = np.lexsort((after, group)) if n >= 2**31 else np.argsort((group << 32) | after, kind="stable")
        pos, after, group = pos[order], after[order], group[order]
        sa[tied] = pos
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        at = np.flatnonzero(new)
        rank[pos] = np.repeat(tied[at], np.diff(np.append(at, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Per place in sa, the length of the common prefix with the suffix before it (0 for the first).

    As in Kasai's method, where the suffix one position earlier has a first byte in common with its
    predecessor, and ours follows that one, one byte less is in common; the others are compared,
    eight bytes a step.
    """
    n = len(sa)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] != before[:-1] + 1) | (before[1:] <= 0) | (before[:-1] < 0) | (text[:-1] != text[before[:-1]])
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    w = words8(text)
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], j[live] + length[live]
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        x = w[a] ^ w[b]
        same = x == 0
        rest = x[~same]
        # whole bytes in common before the first bit that differs
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            lead += (rest >> np.uint64(64 - 8 * k)) == 0
        length[live[~same]] += lead
        live = live[same]
        length[live] += 8
    length = np.minimum(length, n - np.maximum(i, j))
    plcp = np.zeros(n, np.int64)
    plcp[i] = length
    start = np.zeros(n, np.int64)
    start[i] = i
    start[before < 0] = np.flatnonzero(before < 0)
    start = np.maximum.accumulate(start)
    plcp = np.maximum(plcp[start] - (np.arange(n) - start), 0)
    plcp[before < 0] = 0
    return plcp[sa]


def spread(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each position on as rows of words (of words8), what is beyond them zero."""
    steps = -(-length // 8)
    out = words[at[:, None] + 8 * np.arange(steps)]
    if length % 8:
        out[:, -1] &= np.uint64(((1 << (8 * (length % 8))) - 1) << (64 - 8 * (length % 8)))
    return out


def search(words: np.ndarray, sa: np.ndarray, queries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query (rows of spread()) the places [low, high) in sa of the suffixes that begin with it, by binary search.

    words: words8 of the text, then as many of 0xFF as a query has.
    """
    steps = queries.shape[1]
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) if length % 8 == 0 else np.uint64(((1 << (8 * (length % 8))) - 1) << (64 - 8 * (length % 8)))

    def compare(at: np.ndarray, live: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix against the query."""
        out = np.zeros(len(at), np.int8)
        open_ = np.arange(len(at))
        for k in range(steps):
            x = words[at[open_] + 8 * k]
            if k == steps - 1:
                x = x & mask
            y = queries[live[open_], k]
            same = x == y
            out[open_] = np.where(x < y, -1, 1) * ~same
            open_ = open_[same]
            if not len(open_):
                break
        return out

    def bound(upper: bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            c = compare(sa[mid], live)
            right = c <= 0 if upper else c < 0
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        return lo

    low = bound(False, np.zeros(len(queries), np.int64), np.full(len(queries), len(sa)))
    return low, bound(True, low.copy(), np.full(len(queries), len(sa)))
