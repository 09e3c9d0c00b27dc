"""Gradient-boosted regression trees for a binary label, on binned features (numpy)."""

from __future__ import annotations

import numpy as np


class Trees:
    """Complete trees of one depth: ``feature``/``cut`` (trees, 2**depth - 1), ``leaf`` (trees, 2**depth)."""

    def __init__(self, edges, base, feature, cut, leaf):
        self.edges, self.base, self.feature, self.cut, self.leaf = edges, base, feature, cut, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3,
              rate: float = 0.3, bins: int = 32, least: float = 1.0) -> Trees:
    """Newton boosting of the weighted log loss; splits by the histogram of gradients."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    trees = Trees(edges, 0.0, [], [], [])
    b = trees.binned(x)
    n_feat, n_inner = x.shape[1], 2 ** depth - 1
    mean = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    trees.base = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), trees.base)
    rows = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-6)
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, 255, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            start, width = 2 ** level - 1, 2 ** level
            local = node - start
            best = np.full(width, 1e-9)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            parent = total_g ** 2 / (total_h + least)
            for j in range(n_feat):
                cell = local * bins + b[:, j]
                left_g = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                left_h = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g ** 2 / (left_h + least) + right_g ** 2 / (right_h + least) - parent[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[start + k], cut[start + k] = top[k], j, at[k]
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = node - n_inner
        value = -rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + least)
        z += value[leaf]
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.leaf.append(value)
    trees.feature, trees.cut, trees.leaf = map(np.array, (trees.feature, trees.cut, trees.leaf))
    return trees
