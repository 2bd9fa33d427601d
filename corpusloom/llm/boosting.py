"""Histogram gradient-boosted trees for two classes, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, level by level: inner nodes in `feature` and `cut`, leaves in `value`."""

    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # same shape; a row goes right if its value is greater
    value: np.ndarray  # (trees, 2**depth)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees of a row block at once."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 2048):
            block = x[at : at + 2048]
            rows = np.arange(len(block))[:, None]
            node = np.zeros((len(block), len(trees)), np.int64)
            for _ in range(self.depth):
                right = block[rows, self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            out[at : at + 2048] = self.start + self.value[trees, leaf].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, *, trees: int = 160, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: float = 2.0
) -> Forest:
    """Newton boosting of the logistic loss; splits are searched in per-feature histograms.

    Without rows, or with one class only, the forest is empty and scores the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(depth, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), start)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
    raw = np.full(n, start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = (node - first) * bins
            gs, hs = (np.stack([np.bincount(slot + binned[j], weights=w, minlength=width * bins).reshape(width, bins) for j in range(d)]).cumsum(axis=2) for w in (g, h))
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1).argmax(axis=1)
            right = np.zeros(n, bool)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[j, k, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
                    here = node == first + k
                    right[here] = binned[j, here] > b
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        raw += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Forest(depth, np.stack(features), np.stack(cuts), np.stack(values), start)
