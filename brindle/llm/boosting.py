"""Gradient-boosted trees over small whole numbers, trained here with numpy.

Features are bytes, so each is its own histogram of 256 bins. Trees are whole
binary ones of a fixed depth, which are scored for many rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """(trees, inner nodes) features and cuts, (trees, leaves) values, heap order."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x`` (rows, features) uint8."""
        total, rows = np.full(len(x), self.intercept), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 20) -> Trees:
    """Newton boosting of the logistic loss; ``x`` (rows, features) uint8, ``y`` 0 or 1.

    A split leaves ``least`` rows on each side, so that a few wrong labels are not
    learnt one by one. Of equal splits the first feature and the lowest cut count. A
    node that no split helps sends all its rows one way. Both labels must be there.
    """
    share = float(y.mean())
    if not 0 < share < 1:
        raise ValueError("both labels must be there")
    intercept = float(np.log(share / (1 - share)))
    total = np.full(len(x), intercept)
    inner, leaves = (1 << depth) - 1, 1 << depth
    trees = Trees(np.zeros((rounds, inner), np.int64), np.full((rounds, inner), 255, np.uint8), np.zeros((rounds, leaves)), intercept)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.zeros(nodes)
            own = at - first
            for f in range(x.shape[1]):
                place = own * 256 + x[:, f]
                g, h, n = (np.cumsum(np.bincount(place, w, nodes * 256).reshape(nodes, 256), axis=1) for w in (gradient, hessian, None))
                gain = g**2 / (h + l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[(n < least) | (n[:, -1:] - n < least)] = 0
                cut = gain.argmax(axis=1)
                most = gain[np.arange(nodes), cut]
                better = most > best + 1e-9
                best = np.where(better, most, best)
                trees.feature[t, first : first + nodes][better] = f
                trees.cut[t, first : first + nodes][better] = cut[better]
            at = 2 * at + 1 + (x[np.arange(len(x)), trees.feature[t, at]] > trees.cut[t, at])
        leaf = at - inner
        g, h = (np.bincount(leaf, w, leaves) for w in (gradient, hessian))
        trees.value[t] = -rate * g / (h + l2)
        total += trees.value[t, leaf]
    return trees
