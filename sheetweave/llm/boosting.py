"""Gradient-boosted trees for yes/no labels, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass
class Boosted:
    """Complete trees of one depth: features and cuts by level order, and leaf values."""

    features: np.ndarray  # (trees, 2**depth - 1)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, 2**depth)
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base, np.float32)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            total += leaves[node - (len(leaves) - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3,
        least: int = 8, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    n, width = binned.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    logits = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logits))
        slope, curve = p - y, p * (1 - p)
        inner = 2 ** depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            gain, best_f, best_b = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, BINS)
            for f in range(width):
                key = (node - first) * (BINS + 1) + binned[:, f]
                g, h, c = (np.bincount(key, w, count * (BINS + 1)).reshape(count, -1).cumsum(1)
                           for w in (slope, curve, np.ones(n)))
                gr, hr, cr = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gains = g**2 / (h + ridge) + gr**2 / (hr + ridge) - g[:, -1:]**2 / (h[:, -1:] + ridge)
                gains[(c < least) | (cr < least)] = 0
                b = gains.argmax(1)
                better = gains[np.arange(count), b] > gain
                gain[better], best_f[better], best_b[better] = gains[better, b[better]], f, b[better]
            for k in range(count):
                e = edges[best_f[k]]
                feature[first + k], cut[first + k] = best_f[k], e[best_b[k]] if best_b[k] < len(e) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = -rate * g / (h + ridge)
        logits += value[leaf]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Boosted(np.array(features), np.array(cuts, np.float32), np.array(leaves, np.float32), base)
