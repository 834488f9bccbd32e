"""Small tree ensembles in numpy for a few dozen dense features: boosted trees, a random forest, isotonic calibration.

Features are cut into at most 64 bins at quantiles of the training rows.  A tree is
grown level by level from histograms of gradients and weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Tree:
    """Node arrays; a leaf's feature is -1.  Rows at or below the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = self.feature[at]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return self.value[at]
            right = x[inner, feature[inner]] > self.threshold[at[inner]]
            at[inner] = self.left[at[inner]] + right


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]


def grow(binned: np.ndarray, cuts, gradient, hessian, depth: int, least: float, ridge: float, pick=None) -> Tree:
    """A tree whose leaf value is sum(gradient) / (sum(hessian) + ridge).  ``pick`` gives the features tried at a node."""
    columns = binned.shape[1]
    feature, threshold, left, value = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(binned)), 0)]
    while todo:
        node, rows, level = todo.pop()
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        value[node] = total_g / (total_h + ridge)
        if level == depth or total_h < 2 * least:
            continue
        best, split = 1e-9, None
        for j in range(columns) if pick is None else pick():
            sum_g = np.cumsum(np.bincount(binned[rows, j], g, len(cuts[j]) + 1))[:-1]
            sum_h = np.cumsum(np.bincount(binned[rows, j], h, len(cuts[j]) + 1))[:-1]
            if not len(sum_g):
                continue
            gain = sum_g**2 / (sum_h + ridge) + (total_g - sum_g) ** 2 / (total_h - sum_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(sum_h < least) | (total_h - sum_h < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, split = gain[at], (j, at)
        if split:
            j, at = split
            child = len(feature)
            feature[node], threshold[node], left[node] = j, float(cuts[j][at]), child
            for extend, what in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                extend.extend([what, what])
            goes = binned[rows, j] > at
            todo += [(child, rows[~goes], level + 1), (child + 1, rows[goes], level + 1)]
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(value))


def _binned(x, cuts):
    # a value equal to a cut goes left of it
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x, y, weight, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0) -> Boosted:
    """Gradient-boosted trees for the logistic loss."""
    cuts = cut_points(x)
    binned = _binned(x, cuts)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    z, trees = np.full(len(x), base), []
    for _ in range(rounds):
        p = sigmoid(z)
        tree = grow(binned, cuts, weight * (y - p), weight * p * (1 - p) + 1e-9, depth, least / 4, ridge)
        trees.append(tree)
        z += rate * tree.predict(x)
    return Boosted(base, rate, trees)


@dataclass
class Forest:
    trees: list[Tree]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(sum(t.predict(x) for t in self.trees) / len(self.trees), 0, 1)


def forest(x, y, trees: int = 40, depth: int = 10, least: float = 2.0, seed: int = 5) -> Forest:
    """A random forest: bootstrapped rows, a random third of the features at each node, leaves hold the share of ones."""
    random = np.random.Generator(np.random.PCG64(seed))
    cuts = cut_points(x)
    binned = _binned(x, cuts)
    tried = max(2, x.shape[1] // 3)
    pick = lambda: random.choice(x.shape[1], tried, replace=False)
    grown = []
    for _ in range(trees):
        drawn = random.poisson(1.0, len(x)).astype(float)
        grown.append(grow(binned, cuts, drawn * y, drawn, depth, least, 1e-6, pick))
    return Forest(grown)


def isotonic(score, y, weight) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a non-decreasing map from score to probability, for ``np.interp``."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted labels, lowest and highest score
    for s, label, w in zip(score[order], y[order], weight[order]):
        blocks.append([w, w * label, s, s])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w1, l1, _, high = blocks.pop()
            blocks[-1][0] += w1
            blocks[-1][1] += l1
            blocks[-1][3] = high
    points = np.array([[s, (b[1] + 0.01) / (b[0] + 0.1)] for b in blocks for s in (b[2], b[3])])
    return points[:, 0], np.maximum.accumulate(points[:, 1])
