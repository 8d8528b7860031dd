"""Bars for tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.schema import BARS, HOUR_MS

BASE = 1_704_067_200_000


def walk(n: int = 200, asset: str = "x", seed: int = 7, gaps: tuple[int, ...] = ()) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    wick = np.abs(rng.normal(0, 0.004, (2, n)))
    out = pd.DataFrame({"asset": asset, "ts": BASE + np.arange(n) * HOUR_MS, "open": open_, "high": np.maximum(open_, close) * (1 + wick[0]), "low": np.minimum(open_, close) * (1 - wick[1]), "close": close, "volume": rng.lognormal(3, 0.6, n)})
    return out.drop(index=list(gaps)).reset_index(drop=True)


def frame(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf, BARS)


def pandas(df, *by: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by or ("asset", "ts"))).reset_index(drop=True)
