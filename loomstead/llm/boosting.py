"""Gradient-boosted trees on binned features: fitted and applied with numpy alone."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees of one depth over uint8 bins, for the log odds of a label."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of each feature that a tree asks for (of all before there are trees)."""
        used = set(np.unique(np.concatenate([f for f, _, _ in self.trees])).tolist()) if self.trees else range(len(self.edges))
        out = np.zeros((len(self.edges), len(x)), np.uint8)
        for j in used:
            e = self.edges[j]
            out[j] = x[:, j] > e[0] if len(e) == 1 else np.searchsorted(e, x[:, j], side="right")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = (bins[feature[0]] > cut[0]) + 1
            for _ in range((len(feature) + 1).bit_length() - 2):
                at = 2 * at + 1 + (bins[feature[at], rows] > cut[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.25, pull: float = 1.0, share: float = 0.3, seed: int = 1) -> Trees:
    """Second-order boosting of the logistic loss; splits by histograms over bins.

    Each tree sees a seeded share of the features, so that a model leans on several signs of one thing.
    """
    draw = np.random.default_rng(seed)
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append((values[1:] + values[:-1]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(edges, float(np.log(p0 / (1 - p0))))
    bins, z = model.binned(x), np.full(len(y), model.base)
    inner, features = (1 << depth) - 1, x.shape[1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        at = np.zeros(len(y), np.int64)
        seen = np.sort(draw.choice(features, max(1, int(share * features)), replace=False))
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-6)
            local = at - first
            gt, ht = np.bincount(local, g, width), np.bincount(local, h, width)
            parent = gt * gt / (ht + pull)
            for j in seen:
                key = local * BINS + bins[j]
                gs = np.cumsum(np.bincount(key, g, width * BINS).reshape(width, BINS), axis=1)
                hs = np.cumsum(np.bincount(key, h, width * BINS).reshape(width, BINS), axis=1)
                gain = gs**2 / (hs + pull) + (gt[:, None] - gs) ** 2 / (ht[:, None] - hs + pull) - parent[:, None]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = k[better]
            at = 2 * at + 1 + (bins[feature[at], np.arange(len(y))] > cut[at])
        leaf_at = at - inner
        leaf = -rate * np.bincount(leaf_at, g, inner + 1) / (np.bincount(leaf_at, h, inner + 1) + pull)
        model.trees.append((feature, cut, leaf))
        z += leaf[leaf_at]
    return model
