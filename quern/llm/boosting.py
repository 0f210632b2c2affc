"""Gradient-boosted trees for two classes and isotonic calibration, in numpy."""

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BoostedTrees:
    """Trees of a fixed depth over binned features, by second-order steps on the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, f = x.shape
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if n < 2 * self.least or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        # Sparse counts have most of their quantiles at 0: give what is above it cuts of its own.
        edges = [np.unique(np.concatenate([e, np.quantile(v, np.linspace(0, 1, self.bins // 2)[:-1]) if len(v := x[x[:, j] > 0, j]) else e])) for j, e in enumerate(edges)]
        wide = max(map(len, edges)) + 1
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = _sigmoid(score)
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut, split = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf), np.full(2**self.depth - 1, wide)
            for level in range(self.depth):
                k = 2**level
                best = np.full(k, 1e-3)
                for j in range(f):
                    at = node * wide + binned[:, j]
                    sums = [np.bincount(at, w, k * wide).reshape(k, wide).cumsum(1) for w in (g, h, np.ones(n))]
                    (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(nl < self.least) | (nt - nl < self.least)] = -1
                    gain[:, len(edges[j]) :] = -1
                    b = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(k), b] > best)
                    best[better] = gain[better, b[better]]
                    feature[k - 1 + better], cut[k - 1 + better], split[k - 1 + better] = j, edges[j][np.minimum(b[better], len(edges[j]) - 1)], b[better]
                here = k - 1 + node
                node = 2 * node + (binned[np.arange(n), feature[here]] > split[here])
            leaves = 2**self.depth
            gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            value = -self.rate * gl / (hl + self.penalty)
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[here]] > cut[here])
            out += value[node]
        return out


class Isotonic:
    """A non-decreasing map from raw scores to probabilities, by pooling adjacent violators."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        if not len(raw):
            self.x, self.p = np.array([0.0]), np.array([0.5])
            return self
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum, weight, first, last
        for r, v in zip(raw[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(r), float(r)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, w, _, last = blocks.pop()
                blocks[-1][0] += s
                blocks[-1][1] += w
                blocks[-1][3] = last
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        # Smoothed, so that a pure block isn't certain.
        self.p = np.maximum.accumulate(np.array([(b[0] + 0.5 * v) / (b[1] + v) for b in blocks for v in (1.0, 1.0)]))
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.p)
