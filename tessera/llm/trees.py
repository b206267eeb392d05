"""Histogram gradient-boosted trees on numpy arrays, grown level by level and kept flat for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees: node i has children 2i + 1 and 2i + 2; arrays are (trees, nodes) and (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        margin, depth, rows = np.full(len(x), self.base), self.feature.shape[1].bit_length(), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            margin += leaf[node - f.size]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_rows: int = 10) -> Forest:
    """Logistic loss. With no row, or only one label, the forest answers the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, nodes = float(np.log(share / (1 - share))), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    if len(y) < 2 * min_rows or y.min() == y.max():
        return Forest(feature, threshold, leaf, base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin, d = np.full(len(y), base), x.shape[1]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first) * bins
            gain_of = np.zeros((width, d, bins - 1))
            for j in range(d):
                k = at + code[:, j]
                sg, sh, sn = (np.bincount(k, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, None))
                lg, lh, ln = sg[:, :-1], sh[:, :-1], sn[:, :-1]
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
                gain_of[:, j] = np.where((ln >= min_rows) & (tn - ln >= min_rows), gain, 0)
            best = gain_of.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins - 1)
                if gain_of[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        end = node - nodes
        leaf[t] = rate * np.bincount(end, g, nodes + 1) / (np.bincount(end, h, nodes + 1) + ridge)
        margin += leaf[t, end]
    return Forest(feature, threshold, leaf, base)
