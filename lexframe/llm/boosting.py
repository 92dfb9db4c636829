"""Small boosted trees for tabular features, fitted on a bounded sample; a model is a few arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Binary log-loss boosting of complete trees of fixed depth over binned features, with a sigmoid calibration on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.penalty = trees, depth, rate, penalty
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rest = np.arange(len(y)) % 4 == 3
        self._boost(x[~rest], y[~rest])
        self._calibrate(self.margin(x[rest]), y[rest])
        return self

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, limit = np.zeros(2 ** self.depth - 1, np.int64), np.full(2 ** self.depth - 1, np.inf)
            for level in range(self.depth):
                width = 2 ** level
                gains = []
                for f in range(x.shape[1]):
                    key = node * BINS + binned[:, f]
                    g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    left, right = g ** 2 / (h + self.penalty), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.penalty)
                    gains.append((left + right)[:, : max(len(cuts[f]), 1)] if len(cuts[f]) else np.full((width, 1), -np.inf))
                for n in range(width):
                    best = max(range(x.shape[1]), key=lambda f: gains[f][n].max())
                    feature[width - 1 + n] = best
                    if len(cuts[best]):
                        limit[width - 1 + n] = cuts[best][int(gains[best][n].argmax())]
                at = width - 1 + node
                node = 2 * node + (x[np.arange(len(y)), feature[at]] > limit[at])
            g, h = np.bincount(node, grad, 2 ** self.depth), np.bincount(node, hess, 2 ** self.depth)
            leaf = -self.rate * g / (h + self.penalty)
            self.nodes.append((feature, limit, leaf))
            margin += leaf[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in self.nodes:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2 ** level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > limit[at])
            out += leaf[node]
        return out

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        a, b = 1.0, 0.0
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * margin + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            r = p - target
            hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(r * margin).sum(), r.sum()])
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -60, 60)))
