"""Gradient-boosted trees for binary labels, in numpy, with Platt calibration.

Of eight rows six make the trees, one the calibration and one the threshold, so
each of them is judged on rows that it has not seen.  No rows to score give no
scores; a feature that never varies splits nothing; ties between splits go to
the first feature and the lowest cut; no threshold that reaches the precision
is one above 1, which selects nothing.  Features must be finite numbers.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Level-wise trees of a fixed depth over binned features; score() gives calibrated probabilities."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        part = np.arange(len(y)) % 8
        a, b = x[part < 6], y[part < 6].astype(float)
        self.cuts = [np.unique(np.quantile(a[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, a[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        raw, self.trees = np.zeros(len(b)), []
        for _ in range(self.rounds):
            p = _sigmoid(raw)
            g, h = b - p, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(b), np.int64), []
            for level in range(self.depth):
                feature, cut = np.zeros(1 << level, np.int64), np.full(1 << level, self.bins, np.int64)
                best = np.full(1 << level, 1e-9)
                for j in range(x.shape[1]):
                    cell = node * (self.bins + 1) + binned[:, j]
                    n = (1 << level) * (self.bins + 1)
                    gs, hs = (np.bincount(cell, v, n).reshape(-1, self.bins + 1).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    k = gain.argmax(1)
                    top = gain[np.arange(len(k)), k]
                    better = top > best
                    best[better], feature[better], cut[better] = top[better], j, k[better]
                splits.append((feature, cut))
                node = node * 2 + (binned[np.arange(len(b)), feature[node]] > cut[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.l2)
            raw += leaf[node]
            self.trees.append((splits, leaf))
        self.slope, self.offset = self._platt(self.raw(x[part == 6]), y[part == 6].astype(float))
        return self

    @staticmethod
    def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        slope, offset = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(slope * raw + offset)
            w = np.maximum(p * (1 - p), 1e-4)
            grad = np.array([((p - y) * raw).sum() + 1e-2 * (slope - 1), (p - y).sum()])
            hess = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(hess, grad)
            slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
        return float(max(slope, 0.05)), float(offset)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), int)
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float = 0.99) -> float:
        """Midway between the lowest score at which these rows (none of them fitted) reach this precision and the next one; 0.5 at least."""
        p = self.score(x)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero(right >= precision)
        if not len(good):
            return 1.01
        p, k = p[order], good[-1]
        return float(max(0.5, (p[k] + p[min(k + 1, len(p) - 1)]) / 2))


def unseen(n: int) -> np.ndarray:
    """Which of n fitted rows neither trees nor calibration have used."""
    return np.arange(n) % 8 == 7
