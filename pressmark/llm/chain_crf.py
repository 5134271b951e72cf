"""A linear-chain conditional random field in numpy.

Sequences of different lengths are stepped together, longest first, so the cost of
a step is one small matrix operation over all sequences still running.

Defined cases: an empty sequence has no labels and no marginals; equal scores go to the lower label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Steps:
    """Row numbers of all sequences by position: at position t the first ``live[t]`` run."""

    first: np.ndarray
    live: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> "Steps":
        lengths = np.asarray(lengths, np.int64)
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        top = int(lengths.max(initial=0))
        live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), "right")
        return cls(first, live, lengths[order])


@dataclass
class ChainCRF:
    """weights: features x labels; step: labels x labels, added from one position to the next."""

    weights: np.ndarray
    step: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def _forward(self, e: np.ndarray, s: Steps) -> np.ndarray:
        a = e.copy()
        for t in range(1, len(s.live)):
            at = s.first[: s.live[t]] + t
            a[at] += _logsumexp(a[at - 1][:, :, None] + self.step[None], 1)
        return a

    def _backward(self, e: np.ndarray, s: Steps) -> np.ndarray:
        b = np.zeros_like(e)
        for t in range(len(s.live) - 2, -1, -1):
            at = s.first[: s.live[t + 1]] + t
            b[at] = _logsumexp(self.step[None] + (e[at + 1] + b[at + 1])[:, None, :], 2)
        return b

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward probabilities, rows x labels."""
        if not len(x):
            return np.zeros((0, self.weights.shape[1]))
        e, s = self.emissions(x), Steps.of(lengths)
        z = self._forward(e, s) + self._backward(e, s)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely label of every row; ties take the lower label."""
        if not len(x):
            return np.zeros(0, np.int64)
        e, s = self.emissions(x), Steps.of(lengths)
        from_ = np.zeros(e.shape, np.int64)
        for t in range(1, len(s.live)):
            at = s.first[: s.live[t]] + t
            paths = e[at - 1][:, :, None] + self.step[None]
            from_[at] = paths.argmax(1)
            e[at] += paths.max(1)
        out = np.zeros(len(e), np.int64)
        for t in range(len(s.live) - 1, -1, -1):
            n = s.live[t]
            at = s.first[:n] + t
            out[at] = e[at].argmax(1)
            if t + 1 < len(s.live):
                more = at[: s.live[t + 1]]
                out[more] = from_[more + 1, out[more + 1]]
        return out


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, labels: int = 2, l2: float = 1.0, rounds: int = 60) -> ChainCRF:
    """Maximum conditional likelihood with an L2 penalty, by limited-memory BFGS."""
    lengths = np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    rows, f = x.shape
    model = ChainCRF(np.zeros((f, labels)), np.zeros((labels, labels)))
    if not rows:
        return model
    s = Steps.of(lengths)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(rows, bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    gold = np.eye(labels)[y]
    seen_w = x.T @ gold
    seen_t = np.zeros((labels, labels))
    np.add.at(seen_t, (y[inner - 1], y[inner]), 1)
    ends = starts + lengths - 1

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        m = ChainCRF(theta[: f * labels].reshape(f, labels), theta[f * labels :].reshape(labels, labels))
        e = m.emissions(x)
        a, b = m._forward(e, s), m._backward(e, s)
        log_z = _logsumexp(a[ends], 1)
        z_row = np.repeat(log_z, lengths)
        p = np.exp(a + b - z_row[:, None])
        pair = np.exp(a[inner - 1][:, :, None] + m.step[None] + (e[inner] + b[inner])[:, None, :] - z_row[inner][:, None, None]).sum(0)
        value = log_z.sum() - (e * gold).sum() - (m.step * seen_t).sum() + 0.5 * l2 * (theta @ theta)
        grad = np.concatenate([(x.T @ p - seen_w).ravel(), (pair - seen_t).ravel()]) + l2 * theta
        return value, grad

    theta = lbfgs(loss, np.zeros(f * labels + labels * labels), rounds)
    return ChainCRF(theta[: f * labels].reshape(f, labels), theta[f * labels :].reshape(labels, labels))


def lbfgs(loss, theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = grad.copy(), []
        for d, g in reversed(steps):
            k = (d @ q) / (d @ g)
            kept.append(k)
            q -= k * g
        if steps:
            d, g = steps[-1]
            q *= (d @ g) / (g @ g)
        else:
            q /= max(1.0, np.abs(q).max())
        for (d, g), k in zip(steps, reversed(kept)):
            q += d * (k - (g @ q) / (d @ g))
        slope, size = grad @ q, 1.0
        for _ in range(25):
            new = theta - size * q
            v, g2 = loss(new)
            if np.isfinite(v) and v <= value - 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        d, g = new - theta, g2 - grad
        if d @ g > 1e-12:
            steps = [*steps, (d, g)][-memory:]
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        theta, value, grad = new, v, g2
        if done:
            break
    return theta
