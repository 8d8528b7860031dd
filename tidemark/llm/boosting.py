"""Gradient-boosted trees for two classes, in numpy: Newton steps on the logistic loss, complete trees over binned features.

The same rows give the same trees on every machine: the logistic function is built from additions, products and
quotients alone (np.exp differs in its last bits with a CPU's vector instructions), and gradients are summed as
fixed-point integers, so that no sum depends on its order and copies of a feature tie exactly (the first wins).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Units of a gradient in sums; sums of 2^25 rows stay exact in a double.
UNITS = float(1 << 26)
_LN2 = (0.693147180369123816490, 1.90821492927058770002e-10)  # its high and low part


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), the same bits everywhere."""
    x = -np.clip(x, -40.0, 40.0)
    power = np.rint(x / _LN2[0])
    rest = (x - power * _LN2[0]) - power * _LN2[1]
    series = np.ones_like(rest)
    for k in range(14, 0, -1):
        series = 1.0 + rest / k * series
    return 1.0 / (1.0 + np.ldexp(series, power.astype(np.int64)))


@dataclass
class Trees:
    depth: int
    features: np.ndarray  # a tree: feature of each inner node, level by level
    limits: np.ndarray  # a tree: values above it go right
    leaves: np.ndarray  # a tree: log-odds to add
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # a value <= edge i has a code <= i
    share = float(np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    odds, inner = np.full(n, base), (1 << depth) - 1
    out = Trees(depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth)), base)
    flat = codes + np.arange(f) * bins
    for t in range(trees):
        p = logistic(odds)
        g, h = np.rint((y - p) * weight * UNITS), np.rint(p * (1 - p) * weight * UNITS)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = at - first
            cell = (local[:, None] * (f * bins) + flat).ravel()
            gs = np.bincount(cell, np.repeat(g, f), width * f * bins).reshape(width, f, bins)
            hs = np.bincount(cell, np.repeat(h, f), width * f * bins).reshape(width, f, bins)
            gl, hl = gs.cumsum(2) / UNITS, hs.cumsum(2) / UNITS
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    out.features[t, first + k], out.limits[t, first + k] = j, edges[j][b]
            feature, limit = out.features[t][at], out.limits[t][at]
            at = 2 * at + 1 + (x[np.arange(n), feature] > limit)
        leaf = at - inner
        out.leaves[t] = rate * (np.bincount(leaf, g, 1 << depth) / UNITS) / (np.bincount(leaf, h, 1 << depth) / UNITS + ridge)
        odds += out.leaves[t][leaf]
    return out
