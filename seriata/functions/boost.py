"""Gradient boosting of squared errors with histogram trees, in NumPy: nothing is drawn, so equal rows give equal trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def thresholds(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last: between neighbouring values, or at percentiles where there are more values than bins."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.percentile(x, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")


@dataclass(frozen=True)
class Boosting:
    """Trees of `depth` levels; a leaf holds `least` rows at least and its value is shrunk by l2."""

    iterations: int = 200
    rate: float = 0.08
    depth: int = 3
    least: int = 40
    l2: float = 1.0
    bins: int = 255

    def fit_predict(self, x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Fits rows x (n, columns) to y and returns the figures of the rows new."""
        cuts = [thresholds(c, self.bins) for c in x.T]
        coded = lambda rows: np.array([np.searchsorted(t, c) for t, c in zip(cuts, rows.T)], dtype=np.uint8)
        codes, codes_new = coded(x), coded(new)
        fitted, out = np.full(len(y), y.mean()), np.full(len(new), y.mean())
        for _ in range(self.iterations):
            tree, values = self._tree(codes, y - fitted)
            fitted += values[_leaves(tree, codes)]
            out += values[_leaves(tree, codes_new)]
        return out

    def _tree(self, codes: np.ndarray, rest: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """A (column, last bin of the left side) per node and level, and the leaves' values; a node without a split sends all rows left."""
        node, tree = np.zeros(len(rest), dtype=np.int64), []
        for level in range(self.depth):
            k = 1 << level
            gain, column, last = np.zeros(k), np.zeros(k, dtype=np.int64), np.full(k, self.bins)
            for j, code in enumerate(codes):
                at = node * self.bins + code
                n = np.bincount(at, minlength=k * self.bins).reshape(k, -1).cumsum(1)
                s = np.bincount(at, rest, minlength=k * self.bins).reshape(k, -1).cumsum(1)
                n_all, s_all = n[:, -1:], s[:, -1:]
                g = s**2 / (n + self.l2) + (s_all - s) ** 2 / (n_all - n + self.l2) - s_all**2 / (n_all + self.l2)
                g[(n < self.least) | (n_all - n < self.least)] = 0
                best = g.argmax(1)
                better = g[np.arange(k), best] > gain
                gain[better], column[better], last[better] = g[np.arange(k), best][better], j, best[better]
            tree.append((column, last))
            node = _below(node, column, last, codes)
        n, s = (np.bincount(node, w, minlength=1 << self.depth) for w in (None, rest))
        return tree, self.rate * s / np.maximum(n + self.l2, 1e-15)


def _below(node: np.ndarray, column: np.ndarray, last: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return 2 * node + (codes[column[node], np.arange(len(node))] > last[node])


def _leaves(tree: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray) -> np.ndarray:
    node = np.zeros(codes.shape[1], dtype=np.int64)
    for column, last in tree:
        node = _below(node, column, last, codes)
    return node
