"""Gradient-boosted trees for a yes/no label, with monotonic constraints, in numpy.

Training bins every feature at quantiles and grows each tree by depth. A constrained
feature may split only where the two sides' values are in the wanted order, and the
middle of the two values then bounds everything below, so a prediction never falls
where the constraint says it must not. A fitted model is five flat node arrays: a
batch of rows steps down all nodes of a tree at once.

Defined cases: without rows, or with one label only, the forest is a constant, the smoothed share of ones; ties of a
split go to the first found; every feature must have a value (no nan).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees; a leaf is its own child. root: the first node of every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds at quantiles, each in the middle between two values."""
    own = np.unique(values)
    if len(own) < 2:
        return np.zeros(0)
    at = np.unique(np.searchsorted(own, np.quantile(values, np.linspace(0, 1, bins + 1)[:-1], method="lower")))
    at = at[at < len(own) - 1]
    return (own[at] + own[at + 1]) / 2


def fit(x: np.ndarray, y: np.ndarray, order: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 5) -> Forest:
    """order: per feature +1 (never falls), -1 (never rises) or 0. Without rows or with one label, a constant."""
    n, f = x.shape
    p = (y.sum() + 1) / (n + 2)
    start = float(np.log(p / (1 - p)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n == 0 or y.min() == y.max():
        trees = 0
    cuts = [_cuts(x[:, k], bins) for k in range(f)]
    # of equally good splits a constrained feature's comes first
    looked = sorted(range(f), key=lambda k: order[k] == 0)
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in range(f)], 1) if n else np.zeros((0, f), np.int64)
    margin = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g_all, h_all = g[rows].sum(), h[rows].sum()
            me, best = len(nodes), (1e-6, None)
            value = float(np.clip(-g_all / (h_all + l2), low, high))
            nodes.append([0, np.inf, me, me, rate * value])
            if level == depth or len(rows) < 2 * least:
                margin[rows] += rate * value
                return me
            for k in looked:
                width = len(cuts[k]) + 1
                if width < 2:
                    continue
                b = binned[rows, k]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = g_all - gl, h_all - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                # twice the fall in the loss's second-order form, with clipped leaf values
                gain = -(2 * gl * vl + (hl + l2) * vl**2 + 2 * gr * vr + (hr + l2) * vr**2) + 2 * g_all * value + (h_all + l2) * value**2
                gain[(nl < least) | (nr < least)] = 0
                if order[k]:
                    gain[(vr - vl) * order[k] < 0] = 0
                c = int(gain.argmax())
                if gain[c] > best[0] * (1 + 1e-9):
                    best = (float(gain[c]), (k, c, float(vl[c]), float(vr[c])))
            if best[1] is None:
                margin[rows] += rate * value
                return me
            k, c, vl, vr = best[1]
            mid = (vl + vr) / 2
            goes = binned[rows, k] <= c
            below, above = [(low, high), (low, high)] if not order[k] else [(low, mid), (mid, high)][:: int(order[k])]
            left = grow(rows[goes], level + 1, *below)
            right = grow(rows[~goes], level + 1, *above)
            nodes[me] = [k, float(cuts[k][c]), left, right, 0.0]
            return me

        roots.append(grow(np.arange(n), 0, -8.0, 8.0))
    a = np.array(nodes, float).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, np.int64), depth, start)
