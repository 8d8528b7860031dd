"""Evaluation of forecasts: splits, windows, metrics, model comparison in long form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators import ordered
from tidemark.operators.stats import pearson


@dataclass(frozen=True)
class Config:
    """Settings of an evaluation; invalid ones raise."""

    context: int = 512
    horizon: int = 1
    flat: float = 0.0005
    window: int = 1000
    most: int | None = None
    start_ms: int | None = None
    end_ms: int | None = None

    def __post_init__(self) -> None:
        for name in ("context", "horizon", "window"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.flat < 0 or (self.most is not None and self.most < 1):
            raise ValueError("flat must not be negative, most must be 1 or more")


def targets(df: DataFrame, config: Config, by: tuple[str, ...] = t.BY) -> DataFrame:
    """Rows to predict: within the bounds of time, with a whole context before them, the newest `most` of each series."""
    whole = Window.partitionBy(*by)
    rows = df.withColumn("_p", F.row_number().over(whole.orderBy("ts"))).filter(F.col("_p") > config.context)
    if config.start_ms is not None:
        rows = rows.filter(F.col("ts") >= config.start_ms)
    if config.end_ms is not None:
        rows = rows.filter(F.col("ts") <= config.end_ms)
    if config.most is not None:
        rows = rows.withColumn("_q", F.row_number().over(whole.orderBy(F.desc("ts")))).filter(F.col("_q") <= config.most).drop("_q")
    return rows.drop("_p")


def predict_with(df: DataFrame, columns: list[str], context: int, predictor, by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with predicted: predictor(array of shape (rows, context, columns)) over each row's past `context` rows, in batches; NULL without a whole context."""
    past = F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(t.frame(-context, -1, by))

    @F.pandas_udf("double")
    def run(contexts: pd.Series) -> pd.Series:
        out = np.full(len(contexts), np.nan)
        full = [i for i, c in enumerate(contexts) if len(c) == context]
        if full:
            out[full] = predictor(np.array([np.stack(contexts.iloc[i]) for i in full], float))
        return pd.Series(out).where(~np.isnan(out), None)

    return df.withColumn("predicted", run(past))


def target_metrics(rows: DataFrame, actual: str, predicted: str, by: list[str], volatility: str | None = None, horizon: int = 1) -> DataFrame:
    """n, mae, rmse and correlation of a target, in units of volatility * sqrt(horizon) if a volatility is named."""
    own = rows.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    if volatility:
        own = own.filter(F.col(volatility) > 1e-12)
    scale = F.col(volatility) * float(horizon) ** 0.5 if volatility else F.lit(1.0)
    own = own.withColumns({"_a": F.col(actual) / scale, "_p": F.col(predicted) / scale})
    e = F.col("_p") - F.col("_a")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), pearson("_p", "_a").alias("correlation"))


def chrono_split(df: DataFrame, shares: tuple[float, ...] = (0.6, 0.2, 0.2), names: tuple[str, ...] = ("train", "validation", "test"), by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with split, by place in time: each bound is the whole number of rows under the cumulated share."""
    whole = Window.partitionBy(*by)
    own = df.withColumn("_p", F.row_number().over(whole.orderBy("ts"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    out, upto = None, 0.0
    for share, name in zip(shares[:-1], names):
        upto += share
        cond = F.col("_p") <= F.floor(F.col("_n") * F.lit(round(upto, 12)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return own.withColumn("split", out.otherwise(names[-1])).drop("_p", "_n")


def blocks(df: DataFrame, n: int, by: tuple[str, ...] = t.BY, name: str = "block") -> DataFrame:
    """df with its n near-equal blocks in time, from 1; the first ones take the remainder."""
    return df.withColumn(name, F.ntile(n).over(t.order(by)))


def tail_blocks(df: DataFrame, share: float = 0.4, n: int = 4, by: tuple[str, ...] = t.BY) -> DataFrame:
    """Rows of the last share, in n equal blocks (from 0); the remainder at the end is dropped by the rule, not hidden."""
    whole = Window.partitionBy(*by)
    own = df.withColumn("_p", F.row_number().over(whole.orderBy("ts")) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    start = F.floor(F.col("_n") * F.lit(1 - share))
    size = F.floor((F.col("_n") - start) / F.lit(n))
    return own.withColumn("block", F.floor((F.col("_p") - start) / size)).filter((F.col("_p") >= start) & (F.col("block") < n)).drop("_p", "_n")


def windows(df: DataFrame, size: int = 1000, least: int = 3, by: tuple[str, ...] = t.BY) -> DataFrame:
    """df with window (older, middle, recent): the first, middle and last `size` rows, less where a series is short; NULL outside."""
    whole = Window.partitionBy(*by)
    own = df.withColumn("_p", F.row_number().over(whole.orderBy("ts"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    k = F.least(F.lit(size), F.floor(F.col("_n") / F.lit(least)))
    mid = F.floor(F.col("_n") / F.lit(2)) - F.floor(k / F.lit(2))
    p = F.col("_p")
    label = F.when(p <= k, "older").when(p > F.col("_n") - k, "recent").when((p > mid) & (p <= mid + k), "middle")
    return own.withColumn("window", label).drop("_p", "_n")


def unpivot(df: DataFrame, models: list[str], key: list[str], actual: str = "actual") -> DataFrame:
    """Long form: key, actual, model, forecast."""
    return df.select(*key, actual, *models).unpivot([*key, actual], models, "model", "forecast")


def error_profile(long: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """n, mae, rmse, bias, means, deviations, dispersion ratio and correlation over rows with both values."""
    rows = long.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).withColumn("_e", F.col(forecast) - F.col(actual))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("bias"),
        F.avg(forecast).alias("mean_forecast"), F.avg(actual).alias("mean_actual"), F.stddev_samp(forecast).alias("sd_forecast"), F.stddev_samp(actual).alias("sd_actual"), pearson(forecast, actual).alias("pearson"),
    )
    return out.withColumns({"dispersion": F.try_divide("sd_forecast", "sd_actual"), "bias_ratio": F.try_divide("bias", "mean_actual")})


def direction_metrics(rows: DataFrame, actual: str, predicted: str, by: list[str], flat: float = 0.0005) -> DataFrame:
    """Accuracy of directions where the actual one isn't flat, where it is up and where it is down, over rows with an actual return."""
    own = rows.filter(F.col(actual).isNotNull()).withColumn("_a", s.direction(F.col(actual), flat)).withColumn("_p", s.direction(F.col(predicted), flat))
    hit = F.coalesce((F.col("_a") == F.col("_p")).cast("double"), F.lit(0.0))
    on = lambda cond: F.avg(F.when(cond, hit))
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), on(F.col("_a") != 0).alias("accuracy"), on(F.col("_a") == 1).alias("bullish_accuracy"), on(F.col("_a") == -1).alias("bearish_accuracy"),
        F.count_if(F.col("_a") == 1).alias("n_positive"), F.count_if(F.col("_a") == -1).alias("n_negative"), F.count_if(F.col("_a") == 0).alias("n_near_zero"), F.avg(actual).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"),
    )


def forecast_metrics(rows: DataFrame, by: list[str], flat: float = 0.0005) -> DataFrame:
    """by and the 22 figures of a forecast of whole bars: errors of each price and the volume, directions, returns.

    rows: predicted_ and actual_ open, high, low, close, volume and return. Errors count finite pairs; flat actual returns are in no
    denominator of a direction; what is undefined is NULL (counts are 0)."""
    pair = lambda c: s.finite(F.col(f"predicted_{c}")) & s.finite(F.col(f"actual_{c}"))
    off = lambda c: F.when(pair(c), F.col(f"predicted_{c}") - F.col(f"actual_{c}"))
    up, hit = s.direction(F.col("actual_return"), flat), F.col("_hit")
    own = rows.withColumns({"_up": up, "_hit": F.coalesce((up == s.direction(F.col("predicted_return"), flat)).cast("double"), F.lit(0.0))})
    on = lambda cond: F.avg(F.when(cond, hit))
    share = F.when(F.abs("actual_close") > 1e-12, F.abs(off("close")) / F.abs("actual_close"))
    return own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("predictions"), *(F.avg(F.abs(off(c))).alias(f"mae_{c}") for c in ("open", "high", "low", "close", "volume")), F.sqrt(F.avg(F.pow(off("close"), 2))).alias("rmse_close"),
        F.avg(share).alias("mape_close"), F.count(share).alias("mape_close_valid_count"), on(F.col("_up") != 0).alias("directional_accuracy"), on(F.col("_up") == 1).alias("bullish_accuracy"), on(F.col("_up") == -1).alias("bearish_accuracy"),
        F.count_if(F.col("_up") == 1).alias("n_positive_actual"), F.count_if(F.col("_up") == -1).alias("n_negative_actual"), F.count_if(F.col("_up") == 0).alias("n_near_zero_actual"),
        F.count_if((F.col("_up") != 0) & (hit == 1)).alias("n_directional_correct"), F.count_if((F.col("_up") != 0) & (hit == 0)).alias("n_directional_incorrect"),
        F.avg("predicted_return").alias("mean_predicted_return"), F.avg("actual_return").alias("mean_actual_return"), F.avg(F.abs(off("return"))).alias("return_mae"),
        F.sqrt(F.avg(F.pow(off("return"), 2))).alias("return_rmse"), pearson("predicted_return", "actual_return").alias("return_correlation"),
    )


def mape(actual: str, forecast: str) -> Column:
    """Mean absolute error in percent of actuals that aren't about 0."""
    return F.avg(F.when(F.abs(actual) > 1e-12, F.abs((F.col(forecast) - F.col(actual)) / F.col(actual)))) * 100


def compare(long: DataFrame, primary: str, by: list[str]) -> DataFrame:
    """by, model, mae, primary_mae, improvement_pct, winner: each other model against the primary one, on rows where both forecast.

    Rows are paired by a self-join on their key, so uneven gaps never misalign them."""
    key = [c for c in long.columns if c not in ("model", "forecast", "actual")]
    base = long.filter(F.col("model") == primary).select(*key, F.col("forecast").alias("_p"))
    rows = long.filter(F.col("model") != primary).join(base, key).filter("forecast IS NOT NULL AND _p IS NOT NULL AND actual IS NOT NULL")
    out = rows.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"), F.avg(F.abs(F.col("_p") - F.col("actual"))).alias("primary_mae"))
    return out.withColumn("improvement_pct", s.improvement_pct(F.col("mae"), F.col("primary_mae"))).withColumn("winner", s.winner(F.col("primary_mae"), F.col("mae"), primary, "model"))


def window_wins(compared: DataFrame, by: list[str]) -> DataFrame:
    """Wins, losses and ties over windows, and whether one label holds throughout."""
    return compared.groupBy(*by).agg(F.count_if(~F.col("winner").isin("model", "tie")).alias("wins"), F.count_if(F.col("winner") == "model").alias("losses"), F.count_if(F.col("winner") == "tie").alias("ties"), (F.count_distinct("winner") <= 1).alias("consistent"))


def regime_tracking(rows: DataFrame, forecast: str, actual: str, by: list[str], least: int = 5, spread: float = 0.1) -> DataFrame:
    """by, tracks: whether a forecast's means over low, medium and high regimes rise as the actual ones do, with enough spread."""
    place = F.when(F.col("regime") == "low", 1).when(F.col("regime") == "medium", 2).when(F.col("regime") == "high", 3)
    means = rows.filter(place.isNotNull() & F.col(forecast).isNotNull() & F.col(actual).isNotNull()).groupBy(*by, place.alias("_r")).agg(F.count(F.lit(1)).alias("n"), F.avg(forecast).alias("f"), F.avg(actual).alias("a")).filter(F.col("n") >= least)
    w = Window.partitionBy(*by).orderBy("_r")
    steps = means.withColumn("_up", (F.col("f") >= F.lag("f").over(w)) == (F.col("a") >= F.lag("a").over(w)))
    out = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("regimes"), F.bool_and(F.coalesce("_up", F.lit(True))).alias("monotone"), F.try_divide(F.max("f") - F.min("f"), F.avg("f")).alias("spread"))
    return out.withColumn("tracks", (F.col("regimes") >= 2) & F.col("monotone") & (F.col("spread") >= spread))


def trim_extremes(rows: DataFrame, value: str, by: list[str], q: float = 0.99) -> DataFrame:
    """Rows whose size is within the q-quantile of their group."""
    limit = ordered.quantiles(rows, F.abs(value), by, {"_q": q})
    return rows.join(limit, by).filter(F.abs(value) <= F.col("_q")).drop("_q")


def hit_rates(events: DataFrame) -> DataFrame:
    """Hit rates overall, by asset and by direction, in one pass (NULL keys: all)."""
    return events.groupingSets([[], [F.col("asset")], [F.col("signal")]], "asset", "signal").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("hit_rate"), F.avg("forward_return").alias("mean_return"))


def horizon_returns(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """bars exploded over horizons, with the return from the bar before to the horizon's end."""
    base = F.lag("close", 1).over(t.order())
    own = bars.withColumns({f"_h{h}": F.try_divide(F.lead("close", h - 1).over(t.order()) if h > 1 else F.col("close"), base) - 1 for h in horizons})
    return own.select(*bars.columns, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_h{h}").alias("horizon_return")) for h in horizons))).alias("_x")).select(*bars.columns, "_x.*")


def window_records(rows: DataFrame, primary: str, base: str, second: str, scale: str, by: list[str], least: int = 100) -> DataFrame:
    """by, n, low_power, errors and flags of a primary model against a base and a second one, raw and in units of a scale, on rows where all forecast."""
    own = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in ("actual", primary, base, second)) + f" AND `{scale}` > 0")
    e = lambda m: F.abs(F.col(m) - F.col("actual"))
    out = own.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(e(m)).alias(f"mae_{k}") for k, m in (("primary", primary), ("base", base), ("second", second))),
        *(F.avg(e(m) / F.col(scale)).alias(f"nmae_{k}") for k, m in (("primary", primary), ("base", base))), *(F.sqrt(F.avg(F.pow(e(m) / F.col(scale), 2))).alias(f"nrmse_{k}") for k, m in (("primary", primary), ("base", base))),
    )
    return out.withColumns({
        "low_power": F.col("n") < least, "beats_base": F.col("mae_primary") < F.col("mae_base"), "beats_second": F.col("mae_primary") < F.col("mae_second"),
        "beats_norm": F.col("nmae_primary") < F.col("nmae_base"), "beats_norm_rmse": F.col("nrmse_primary") < F.col("nrmse_base"), "leaks": F.lit(0),
    })
