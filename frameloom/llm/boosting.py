"""Histogram gradient-boosted trees for a yes-or-no target, in numpy.

Features are cut at quantiles into at most 64 bins.  Trees grow level by level;
a level's gradient histograms come from one ``bincount`` per feature.  Trees are
complete, so a forest is three arrays, and rows descend all at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # trees x inner nodes, in heap order
    cut: np.ndarray  # go right where the value exceeds it
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth = (self.feature.shape[1] + 1).bit_length() - 1 if self.feature.size else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """``least``: hessian that a child needs.  One class alone, or no rows, gives
    a constant: the smoothed share of ones."""
    n, f = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    margin = np.full(n, base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            place = (node - first) * bins
            best = np.full(width, 1e-6)
            choice, at = np.zeros(width, np.int64), np.full(width, -1)
            for j in range(f):
                g = np.bincount(place + binned[j], grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(place + binned[j], hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < least) | (ht - h < least)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    found = gain[np.arange(width), k]
                    better = found > best
                    best, choice, at = np.where(better, found, best), np.where(better, j, choice), np.where(better, k, at)
            for i in range(width):
                if at[i] >= 0:
                    feature[first + i], cut[first + i] = choice[i], edges[choice[i]][at[i]]
            right = (binned[choice[node - first], np.arange(n)] > at[node - first]) & (at[node - first] >= 0)
            node = 2 * node + 1 + right
        low = node - inner
        value = -rate * np.bincount(low, grad, leaves) / (np.bincount(low, hess, leaves) + ridge)
        margin += value[low]
        out.append((feature, cut, value))
    return Forest(base, *(np.stack(c) for c in zip(*out)))
