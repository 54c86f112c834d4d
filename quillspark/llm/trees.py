"""Boosted trees for small tables at the driver: logistic loss, histogram splits.

Used on bounded samples only; scoring is vectorised numpy and runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in level order: node k has children 2k+1 and 2k+2; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            go = f >= 0
            right = np.zeros(len(x), bool)
            right[go] = x[np.flatnonzero(go), f[go]] > self.threshold[at[go]]
            at = np.where(go, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaves(x)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def cut_points(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Candidate thresholds of every feature: midpoints between neighbouring quantiles."""
    out = []
    for k in range(x.shape[1]):
        u = np.unique(x[:, k])
        if len(u) > most:
            u = np.unique(np.quantile(x[:, k], np.linspace(0, 1, most), method="nearest"))
        out.append((u[1:] + u[:-1]) / 2)
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    at = np.zeros(len(g), np.int64)
    bins = max((len(c) for c in cuts), default=0) + 1
    d = binned.shape[1]
    for node in range(size):
        rows = np.flatnonzero(at == node)
        if not len(rows):
            continue
        sg, sh = g[rows].sum(), h[rows].sum()
        value[node] = -sg / (sh + ridge)
        if 2 * node + 2 >= size or len(rows) < 2:
            continue
        flat = (binned[rows] + np.arange(d) * bins).ravel()
        hg = np.bincount(flat, np.repeat(g[rows], d), d * bins).reshape(d, bins).cumsum(1)
        hh = np.bincount(flat, np.repeat(h[rows], d), d * bins).reshape(d, bins).cumsum(1)
        gain = hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge)
        gain[(hh < least) | (sh - hh < least)] = 0
        best = int(gain.argmax())
        f, b = divmod(best, bins)
        if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
            continue
        feature[node], threshold[node] = f, cuts[f][b]
        at[rows] = 2 * node + 1 + (binned[rows, f] > b)
    return Tree(feature, threshold, value)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 1.0, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Gradient boosting with Newton leaves; the same rows give the same trees."""
    weight = np.ones(len(y)) if weight is None else weight
    p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4) if len(y) else 0.5
    model = Boosted(float(np.log(p / (1 - p))), [])
    if not len(y):
        return model
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        q = sigmoid(raw)
        t = _grow(binned, cuts, (q - y) * weight, np.maximum(q * (1 - q), 1e-6) * weight, depth, least, ridge)
        t.value *= rate
        model.trees.append(t)
        raw += t.value[t.leaves(x)]
    return model
