"""Gradient-boosted regression trees for a yes/no target: logistic loss, histograms of binned features, numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: feature and threshold of inner nodes, values of leaves; `base` is the bias."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.features.shape[1] + 1).bit_length() - 1
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(len(x), base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    out = {"f": [], "t": [], "v": []}
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        gradient, curve = weight * (chance - y), weight * chance * (1 - chance)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * (bins + 1) + binned[:, f]
                g = np.bincount(key, gradient, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                h = np.bincount(key, curve, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                gain = gain[:, :len(e)]
                place = gain.argmax(axis=1)
                better = gain[np.arange(width), place] > best
                best[better] = gain[np.arange(width), place][better]
                feature[first + np.flatnonzero(better)] = f
                threshold[first + np.flatnonzero(better)] = e[place[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        score += value[leaf]
        out["f"].append(feature)
        out["t"].append(threshold)
        out["v"].append(value)
    return Trees(np.array(out["f"]), np.array(out["t"]), np.array(out["v"]), base)
