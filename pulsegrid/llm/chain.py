"""Linear-chain conditional random fields with two labels, vectorised over all sequences of a batch.

Scores: an item's label 1 gets the sum of its features' weights, a pair of neighbours the transition weight of their
labels, a first item the start weight of its label. Forward and backward passes are products of 2 x 2 matrices, scanned in
blocks: each step handles one place of every block of every sequence at once. Blocks belong to one sequence and all sums
run item by item, so a sequence's values are the same bits whatever shares its batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK = 16


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products of (4, n) stacks, scaled by their largest entry."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(axis=0)


def _scan(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(2, n): for each item the row vector (1/2, 1/2) times the matrices (4, n) from its sequence's first one to its own,
    scaled to sum 1. ``first`` marks where sequences begin.

    Every sequence fills rows of ``BLOCK`` matrices of its own, so its results don't depend on the others.
    """
    n = m.shape[1]
    begins = np.flatnonzero(first)
    lengths = np.diff(np.append(begins, n))
    rows = -(-lengths // BLOCK)
    row_begins = np.cumsum(rows) - rows
    place = np.arange(n) + np.repeat(row_begins * BLOCK - begins, lengths)
    total = int(rows.sum())
    padded = np.zeros((4, total * BLOCK))
    padded[0] = padded[3] = 1.0
    padded[:, place] = m
    steps = np.ascontiguousarray(padded.reshape(4, total, BLOCK).transpose(2, 0, 1))
    start = np.full((2, total), 0.5)
    if total > len(begins):
        whole = steps[0] / steps[0].max(axis=0)
        for step in steps[1:]:
            whole = _product(whole, step)
        row_first = np.zeros(total, dtype=bool)
        row_first[row_begins] = True
        before = _scan(whole, row_first)
        start[:, 1:] = np.where(row_first[1:], 0.5, before[:, :-1])
    out = np.empty((BLOCK, 2, total))
    x, y = start
    for i, step in enumerate(steps):
        x, y = x * step[0] + y * step[2], x * step[1] + y * step[3]
        s = x + y
        x, y = x / s, y / s
        out[i, 0], out[i, 1] = x, y
    return out.transpose(1, 2, 0).reshape(2, -1)[:, place]


@dataclass
class Chain:
    """Weights of the features (by number), of transitions [from, to] and of a first label."""

    weights: np.ndarray
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def passes(self, score: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward vectors (2, n) and the matrices (4, n). ``first`` marks the first item of a sequence."""
        lift = np.exp(np.clip(score, -30, 30))
        t, s = np.exp(self.transition), np.exp(self.start)
        m = np.stack([np.where(first, s[j], t[i, j]) * (lift if j else 1.0) for i in (0, 1) for j in (0, 1)])
        m /= m.max(axis=0)
        ahead = _scan(m, first)
        # backwards each sequence begins with its last item, which nothing follows
        last = np.append(first[1:], True)
        behind = np.where(last, np.array([[1.0], [0.0], [0.0], [1.0]]), np.roll(m[[0, 2, 1, 3]], -1, axis=1))
        back = _scan(np.ascontiguousarray(behind[:, ::-1]), last[::-1])[:, ::-1]
        return ahead, back, m

    def marginals(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every item."""
        if not len(score):
            return np.zeros(0)
        ahead, back, _ = self.passes(score, first)
        both = ahead * back
        return both[1] / both.sum(axis=0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, size: int, steps: int = 80, rate: float = 0.15, ridge: float = 1e-5) -> Chain:
    """Maximum conditional likelihood by Adam over the whole (bounded) sample.

    ``features``: (items, k) numbers below ``size``; ``labels``: 0 or 1; ``first``: marks where sequences begin.
    """
    chain, n = Chain(np.zeros(size)), len(labels)
    y = labels.astype(np.int64)
    inner = np.flatnonzero(~first)
    pairs = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).astype(float)
    begins = np.bincount(y[first], minlength=2).astype(float)
    flat = features.ravel()
    mean, power = np.zeros(size + 6), np.zeros(size + 6)
    values = np.zeros(size + 6)
    for step in range(1, steps + 1):
        chain = Chain(values[:size], values[size : size + 4].reshape(2, 2), values[size + 4 :])
        ahead, back, m = chain.passes(chain.scores(features), first)
        both = ahead * back
        p = both / both.sum(axis=0)
        joint = ahead[:, None, inner - 1] * m.reshape(2, 2, n)[:, :, inner] * back[None, :, inner]
        joint /= joint.sum(axis=(0, 1))
        slope = np.concatenate([
            np.bincount(flat, weights=np.repeat(y - p[1], features.shape[1]), minlength=size),
            pairs - joint.sum(axis=2).ravel(), begins - p[:, first].sum(axis=1),
        ]) / n - ridge * values
        mean = 0.9 * mean + 0.1 * slope
        power = 0.99 * power + 0.01 * slope**2
        values = values + rate * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    return Chain(values[:size], values[size : size + 4].reshape(2, 2), values[size + 4 :])


def calibrated(x: np.ndarray, labels: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights (with the constant last) of a logistic regression of ``labels`` on the columns of ``x``, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (labels - p) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Column by column: a matrix product rounds by the number of rows."""
    total = np.full(len(x), weights[-1])
    for column, weight in zip(x.T, weights):
        total = total + np.ascontiguousarray(column) * weight
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))
