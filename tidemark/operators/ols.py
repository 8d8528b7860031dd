"""Least squares over moving frames without a loop.

A fit only needs the sums of products of its terms. They are window sums, so a walk
of n fits costs one pass; small systems are then solved in batches by numpy. Terms
are centred on the series' mean first, which keeps the normal equations well
conditioned, and singular systems get the minimum-norm solution.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.functions.scalars import finite


#: Rows of a frame from which its sums are differences of running sums.
LONG = 64


def moments(df: DataFrame, y: str, xs: list[str], window: int | None, shift: int = 1, by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with n_obs, `moments` (sums of products of y and the terms with a leading 1, over complete rows: all finite) and `centre`.

    window: rows of the frame that ends `shift` rows before each (None: all of them). Sums of long frames are differences of sums from the
    series' start on, and those are scans over blocks, so that a series isn't held by one task."""
    names = [*xs, y]
    complete = F.lit(True)
    for c in names:
        complete = complete & finite(F.col(c))
    had = blocks.AT in df.columns
    own = blocks.placed(df, by).withColumns({"_ok": complete, blocks.KEY: blocks.key_of(by)})
    # centred on the first complete row, so that no later row has a say
    first = own.groupBy(blocks.KEY).agg(F.min_by(F.struct(*(F.col(c).cast("double").alias(f"_c_{c}") for c in names)), F.when(F.col("_ok"), F.col("ts"))).alias("_c"))
    own = own.join(first, blocks.KEY).drop(blocks.KEY)
    own = own.withColumns({f"_z_{c}": F.when(F.col("_ok"), F.col(c) - F.col(f"_c._c_{c}")) for c in names})
    term = {"1": F.col("_ok").cast("double")} | {c: F.col(f"_z_{c}") for c in names}
    products = {f"_s_{k}": term[a] * term[b] for k, (a, b) in enumerate(combinations_with_replacement(["1", *names], 2))}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if window is not None and window < LONG:
        w = t.frame(-window - shift + 1, -shift, by)
        summed = blocks.bounded(own, lambda x: x.withColumns({k: zero(F.sum(c).over(w)) for k, c in products.items()}), window + shift, by=by)
    else:
        upto = blocks.running(own, {k: ("sum", c) for k, c in products.items()}, by)

        def between(x: DataFrame) -> DataFrame:
            back = lambda k, n: zero(F.lag(k, n).over(t.order(by)))
            return x.withColumns({k: back(k, shift) - (back(k, shift + window) if window else F.lit(0.0)) for k in products})

        summed = blocks.bounded(upto, between, shift + (window or 0), by=by)  # linear in rows, whatever the width
    out = summed.withColumn("moments", F.array(*products)).withColumn("n_obs", F.round("_s_0").cast("long"))
    out = out.withColumn("centre", F.array(*(zero(F.col(f"_c._c_{c}")) for c in names))).drop("_ok", "_c", *products, *(f"_z_{c}" for c in names))
    return out if had else out.drop(blocks.AT)


def solve(k: int) -> "Column":
    """Vectorised function: (moments, centre) to coefficients (constant first) of k terms."""

    @F.pandas_udf("array<double>")
    def of(sums: pd.Series, centre: pd.Series) -> pd.Series:
        size = k + 2
        m, c = np.stack(sums.to_numpy()), np.stack(centre.to_numpy())
        full = np.zeros((len(m), size, size))
        for i, (a, b) in enumerate(combinations_with_replacement(range(size), 2)):
            full[:, a, b] = full[:, b, a] = m[:, i]
        xx, xy = full[:, : k + 1, : k + 1], full[:, : k + 1, k + 1]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(xx / (scale[:, :, None] * scale[:, None, :]), rcond=1e-13, hermitian=True), xy / scale) / scale
        beta[:, 0] += c[:, k] - (beta[:, 1:] * c[:, :k]).sum(1)
        return pd.Series(list(beta))

    return of


def walk(df: DataFrame, y: str, xs: list[str], window: int | None = None, least: int = 24, shift: int = 1, by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with n_obs, beta (constant first) and forecast of each row, fitted on the rows before it; NULL under `least` of them."""
    fitted = moments(df, y, xs, window, shift, by)
    enough = F.col("n_obs") >= least
    # only rows with a fit go to Python: the others get a zero system
    out = fitted.withColumn("beta", F.when(enough, solve(len(xs))(F.col("moments"), F.col("centre"))))
    forecast = F.element_at("beta", 1)
    for i, x in enumerate(xs):
        forecast = forecast + F.element_at("beta", i + 2) * F.col(x)
    return out.withColumn("forecast", F.when(finite(forecast), forecast)).drop("moments", "centre")


def walk_exact(df: DataFrame, y: str, xs: list[str], window: int | None = None, least: int = 24, by: tuple[str, ...] = t.BY) -> DataFrame:
    """As walk, by one least-squares call a row within each series: slow, for parity tests."""
    columns = [f.name for f in df.schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x, v = pdf[xs].to_numpy(float), pdf[y].to_numpy(float)
        ok = ~np.isnan(np.column_stack([x, v])).any(1)
        out, n = np.full(len(pdf), np.nan), np.zeros(len(pdf), int)
        for i in range(len(pdf)):
            a = 0 if window is None else max(0, i - window)
            rows = np.flatnonzero(ok[a:i]) + a
            n[i] = len(rows)
            if len(rows) >= least and not np.isnan(x[i]).any():
                beta = np.linalg.lstsq(np.column_stack([np.ones(len(rows)), x[rows]]), v[rows], rcond=None)[0]
                out[i] = beta[0] + x[i] @ beta[1:]
        return pdf[columns].assign(n_obs=n, forecast=pd.Series(out).where(~np.isnan(out), None))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", n_obs long, forecast double"
    return df.groupBy(*by).applyInPandas(run, schema)


def walk_model(df: DataFrame, features: list[str], y: str, fit, every: int = 100, least: int = 500, by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with forecast by any model: fit(x, y) returns a function of x; it is called anew after every `every` rows on the complete rows before.

    fit is a plain Python callable (trees, neighbours and so on) and runs once a series and refit."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", forecast double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        x, v = pdf[features].to_numpy(float), pdf[y].to_numpy(float)
        ok, out = ~np.isnan(x).any(1), np.full(len(pdf), np.nan)
        for a in range(least, len(pdf), every):
            past = np.flatnonzero(ok[:a] & ~np.isnan(v[:a]))
            rows = np.flatnonzero(ok[a : a + every]) + a
            if len(past) and len(rows):
                out[rows] = fit(x[past], v[past])(x[rows])
        return pdf.assign(forecast=pd.Series(out).where(~np.isnan(out), None))

    return df.groupBy(*by).applyInPandas(run, schema)


def hedge_ratio(df: DataFrame, y: str, x: str, window: int, shift: int = 1, by: tuple[str, ...] = t.BY) -> Column:
    """Covariance over variance of x, over a past window."""
    w = t.frame(-window - shift + 1, -shift, by)
    return F.when(F.count(F.col(y) * F.col(x)).over(w) >= window, F.try_divide(F.covar_samp(y, x).over(w), F.var_samp(x).over(w)))
