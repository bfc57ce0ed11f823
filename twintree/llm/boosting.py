"""Gradient-boosted trees for two classes and isotonic calibration, in numpy, for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Trees of equal depth: split feature and threshold by node (1-based heap order), values by leaf."""

    base: float
    depth: int
    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, f[node]] > t[node])
            out += v[node - 2**self.depth]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 2.0,
    least: float = 1.0) -> BoostedTrees:
    """Logistic loss; splits are sought over quantile bins. least: the smallest hessian sum of a child."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    # zero parts rows that have a trait from those that lack it, however few they are
    edges = [np.unique(np.append(e, 0.0)) for e in edges]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    features = np.zeros((trees, 2**depth), dtype=np.int64)
    thresholds = np.full((trees, 2**depth), np.inf)
    values = np.zeros((trees, 2**depth))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.ones(n, dtype=np.int64)
        for d in range(depth):
            low = 2**d
            best = np.full(low, 1e-6)
            for j in range(m):
                at = (node - low) * width + binned[:, j]
                gs = np.bincount(at, g, low * width).reshape(low, width)
                hs = np.bincount(at, h, low * width).reshape(low, width)
                gl, hl = np.cumsum(gs, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
                gt, ht = gs.sum(axis=1, keepdims=True), hs.sum(axis=1, keepdims=True)
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(edges[j]) :] = 0
                pick = gain.argmax(axis=1)
                top = gain[np.arange(low), pick]
                for q in np.flatnonzero(top > best):
                    best[q] = top[q]
                    features[k, low + q], thresholds[k, low + q] = j, edges[j][pick[q]]
            node = 2 * node + (x[np.arange(n), features[k, node]] > thresholds[k, node])
        leaf = node - 2**depth
        values[k] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        margin += values[k][leaf]
    return BoostedTrees(base, depth, features, thresholds, values)


@dataclass
class Isotonic:
    """A non-decreasing map from margins to probabilities, linear between its knots."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; every block's mean counts half a positive and half a negative row more."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    value = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks]))
    at, first = np.unique(at, return_index=True)
    return Isotonic(at, value[first])
