"""Boosted regression trees for walks: histograms of quantile bins, squared loss, gain importances.

`booster()` gives a fit function for `ols.walk_model`; `importances` walks a series' refits and
reports how much of the loss each feature explains.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Trees:
    """Trees of equal depth over binned features; gains are summed by feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 20) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        self.base, self.gains, self.nodes = float(y.mean()), np.zeros(k), []
        left = y - self.base
        for _ in range(self.n_trees):
            at = np.zeros(n, np.int64)
            splits: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(self.depth):
                width = 1 << level
                feature, limit = np.zeros(width, np.int64), np.full(width, self.bins)  # all go left
                for node in range(width):
                    own = np.flatnonzero(at == node)
                    if len(own) < 2 * self.least:
                        continue
                    gain, feature[node], limit[node] = self._split(codes[own], left[own])
                    self.gains[feature[node]] += gain
                splits.append((feature, limit))
                at = 2 * at + (codes[np.arange(n), feature[at]] > limit[at])
            count = np.bincount(at, minlength=1 << self.depth)
            leaf = self.rate * np.bincount(at, left, 1 << self.depth) / np.maximum(count, 1)
            left = left - leaf[at]
            self.nodes.append((splits, leaf))
        return self

    def _split(self, codes: np.ndarray, y: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin that goes left) of the best split; none: no gain, all left."""
        best = (0.0, 0, self.bins)
        total, n = y.sum(), len(y)
        for j in range(codes.shape[1]):
            sums, counts = np.cumsum(np.bincount(codes[:, j], y, self.bins)), np.cumsum(np.bincount(codes[:, j], minlength=self.bins))
            ok = (counts >= self.least) & (n - counts >= self.least)
            if ok.any():
                gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, -np.inf)
                at = int(gain.argmax())
                if gain[at] > best[0] + 1e-12:
                    best = (float(gain[at]), j, at)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for feature, limit in splits:
                at = 2 * at + (codes[rows, feature[at]] > limit[at])
            out += leaf[at]
        return out


def booster(**settings):
    """A fit function for walks."""
    return lambda x, y: Trees(**settings).fit(x, y).predict


def importances(df: DataFrame, features: list[str], y: str, every: int = 100, least: int = 500, by: tuple[str, ...] = ("asset",), **settings) -> DataFrame:
    """by, feature, importance (mean share of the gain over the walk's refits, each on all complete rows before it) and refits."""
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, v = pdf[features].to_numpy(float), pdf[y].to_numpy(float)
        ok, shares = np.isfinite(x).all(1) & np.isfinite(v), []
        for a in range(least, len(pdf), every):
            past = np.flatnonzero(ok[:a])
            if len(past):
                gains = Trees(**settings).fit(x[past], v[past]).gains
                shares.append(gains / gains.sum() if gains.sum() else gains)
        mean = np.mean(shares, 0) if shares else np.zeros(len(features))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), f, m, len(shares)] for f, m in zip(features, mean)], columns=[*by, "feature", "importance", "refits"])

    return df.select(*by, "ts", *features, F.col(y)).groupBy(*by).applyInPandas(run, f"{keys}, feature string, importance double, refits long")
