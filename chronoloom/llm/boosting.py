"""Gradient-boosted trees and isotonic calibration for small dense tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Depth-bound regression trees on log-odds: features are binned at ``edges``; each tree is (feature, bin, left, right, value) arrays."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _leaf_values(tree, b)
        return out


def _leaf_values(tree: tuple, b: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = tree
    node = np.zeros(len(b), np.int64)
    while True:
        live = np.flatnonzero(feature[node] >= 0)
        if not len(live):
            return value[node]
        at = node[live]
        node[live] = np.where(b[live, feature[at]] <= cut[at], left[at], right[at])


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss with histogram splits."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(p / (1 - p))))
    b = model.bins(x)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(b, q - y, q * (1 - q), [len(e) for e in edges], depth, rate, least, ridge)
        model.trees.append(tree)
        margin += _leaf_values(tree, b)
    return model


def _grow(b, grad, hess, n_edges, depth, rate, least, ridge):
    feature, cut, left, right, value = [], [], [], [], []

    def add(rows, level):
        me = len(feature)
        for column, v in ((feature, -1), (cut, 0), (left, 0), (right, 0), (value, 0.0)):
            column.append(v)
        g, h = grad[rows].sum(), hess[rows].sum()
        value[me] = -rate * g / (h + ridge)
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for k, n in enumerate(n_edges):
                if not n:
                    continue
                own = b[rows, k]
                gl, hl, cl = (np.cumsum(np.bincount(own, w, n + 1))[:-1] for w in (grad[rows], hess[rows], None))
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(cl < least) | (len(rows) - cl < least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, at)
        if best[1] is not None:
            feature[me], cut[me] = best[1], best[2]
            goes = b[rows, best[1]] <= best[2]
            left[me] = add(rows[goes], level + 1)
            right[me] = add(rows[~goes], level + 1)
        return me

    add(np.arange(len(grad)), 0)
    return tuple(np.array(c) for c in (feature, cut, left, right, value))


@dataclass
class Isotonic:
    """A rising step function with straight lines between the steps' means."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.to), 0.0, 1.0)


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators, rows by weight; one smoothing row of either label at the ends keeps scores off 0 and 1."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sums of margins, labels and weights
    for m, v, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([m * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + c for a, c in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    at = np.array([s / n for s, _, n in blocks])
    ends = (0, len(blocks) - 1)
    to = np.array([(v + 0.5 * (i in ends)) / (n + 1.0 * (i in ends)) for i, (_, v, n) in enumerate(blocks)])
    return Isotonic(at, np.maximum.accumulate(to))
