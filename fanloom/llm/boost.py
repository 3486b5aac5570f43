"""Gradient-boosted trees with logistic loss, isotonic calibration and thresholds, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Newton boosting of depth-limited trees over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)
        base = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(base / (1 - base)))
        score = np.full(len(y), self.base)
        self.nodes = []  # each tree: feature and cut of every inner node (heap order), values of the leaves
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, BINS)
            at = np.zeros(len(y), int)
            for node in range(2**self.depth - 1):
                own = np.flatnonzero(at == node)
                best = 1e-9
                if len(own) > 1:
                    gs, hs = g[own].sum(), h[own].sum()
                    flat = gs * gs / (hs + self.ridge)
                    for k in range(x.shape[1]):
                        b = binned[own, k]
                        gl = np.cumsum(np.bincount(b, g[own], BINS))[:-1]
                        hl = np.cumsum(np.bincount(b, h[own], BINS))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - flat
                        c = int(gain.argmax())
                        if gain[c] > best:
                            best, feature[node], cut[node] = gain[c], k, c
                right = binned[own, feature[node]] > cut[node]
                at[own] = 2 * node + 1 + right
            leaf = at - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge) * self.rate
            self.nodes.append((feature, cut, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing function that fits y best (pool adjacent violators): (scores, values)."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # mean, weight, least score
    for s, v in zip(score[order], y[order]):
        pools.append([float(v), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            n = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2]])
    return np.array([p[2] for p in pools]), np.array([(p[0] * p[1] + 0.5 * 0.1) / (p[1] + 0.1) for p in pools])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    at, value = steps
    return value[np.clip(np.searchsorted(at, score, "right") - 1, 0, len(at) - 1)]


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability threshold of the best F1 on held-out rows (ties: the highest but one half at most)."""
    best, at = -1.0, 0.5
    for t in np.unique(np.concatenate([p, [0.5]])):
        if t <= 0:
            continue
        hit = p >= t
        tp = (hit & (y > 0)).sum()
        f1 = 2 * tp / max(hit.sum() + (y > 0).sum(), 1)
        if f1 > best + 1e-12 or (abs(f1 - best) <= 1e-12 and t <= 0.5):
            best, at = f1, float(t)
    return min(at, 0.9)
