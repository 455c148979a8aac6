"""Gradient-boosted trees on binned features, for two classes."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, second-order gains, complete trees of a fixed depth over at most ``bins`` quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 16, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
        b, n_features = self._binned(x), x.shape[1]
        flat = b + np.arange(n_features) * self.bins
        p0 = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(p0 / (1 - p0))), []
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = w * (p - y), w * p * (1 - p)
            at = np.zeros(len(y), np.int64)
            levels = []
            for level in range(self.depth):
                nodes = 1 << level
                cell = (at[:, None] * (n_features * self.bins) + flat).ravel()
                size = nodes * n_features * self.bins
                g, h = (np.bincount(cell, np.repeat(v, n_features), size).reshape(nodes, n_features, self.bins).cumsum(2) for v in (grad, hess))
                gt, ht = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                gain[:, :, -1] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                feature, cut = best // self.bins, best % self.bins
                levels.append((feature, cut))
                at = at * 2 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + self.ridge)
            self.trees.append((levels, value))
            margin += value[at]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        b, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for levels, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                at = at * 2 + (b[rows, feature[at]] > cut[at])
            out += value[at]
        return out
