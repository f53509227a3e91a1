"""Logistic regression on sparse features, with an optional penalty on logit differences of pairs.

Used on bounded samples on the driver; what it returns is a bounded vector of weights.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Sparse:
    """Rows of (feature, value); products with dense vectors."""

    def __init__(self, rows: Sequence[tuple[Sequence[int], Sequence[float]]], width: int):
        sizes = [len(ids) for ids, _ in rows]
        self.shape = (len(rows), width)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.col = np.concatenate([np.asarray(ids, np.int64) for ids, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([np.asarray(values, np.float64) for _, values in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.shape[0])

    def transposed_dot(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * e[self.row], minlength=self.shape[1])


def objective(x: Sparse, y: np.ndarray, weight: np.ndarray, pairs: Sparse | None, penalty: float, l2: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Value, and gradient in w and b, of weighted log loss + penalty * mean squared pair difference + l2 * |w|^2."""
    z = x.dot(w) + b
    value = float((weight * (np.logaddexp(0.0, z) - y * z)).sum() + l2 * (w @ w))
    error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
    grad = x.transposed_dot(error) + 2 * l2 * w
    if pairs is not None and pairs.shape[0]:
        change = pairs.dot(w)
        value += penalty * float((change * change).mean())
        grad = grad + (2 * penalty / pairs.shape[0]) * pairs.transposed_dot(change)
    return value, grad, float(error.sum())


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, pairs: Sparse | None = None, penalty: float = 0.0, l2: float = 2e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of least :func:`objective`, by Adam with a falling rate; ``weight`` is scaled to sum to 1."""
    weight = weight / weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        _, gw, gb = objective(x, y, weight, pairs, penalty, l2, w, b)
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * min(1.0, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b
