"""Range forecasts and volatility regimes. Every forecast of a row uses rows before it only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.operators import ols
from tidemark.schema import DAY_MS


def ranges(bars: DataFrame) -> DataFrame:
    """bars with range (high - low, not below 0; NULL if not finite)."""
    r = F.greatest(F.col("high") - F.col("low"), F.lit(0.0))
    return bars.withColumn("range", F.when(~F.isnan(r), r))


def persistence(c: str = "range") -> Column:
    return t.lag(c)


def har_terms(df: DataFrame, c: str = "range", windows: tuple[int, int, int] = (1, 5, 22)) -> DataFrame:
    """df with the terms of a heterogeneous autoregression: means of the last 1, 5 and 22 past values."""
    return blocks.bounded(df, lambda x: x.withColumns({f"m{w}": t.mean(c, w, shift=1) for w in windows}), max(windows) + 1)


def har(df: DataFrame, c: str = "range", window: int | None = None, least: int = 24, windows: tuple[int, int, int] = (1, 5, 22), positive: bool = False) -> DataFrame:
    """df with n_obs, beta and har: one step ahead, fitted on past rows (all, or a rolling window of them)."""
    own = har_terms(blocks.placed(df), c, windows)
    out = ols.walk(own, c, [f"m{w}" for w in windows], window, least).withColumnRenamed("forecast", "har").drop(blocks.AT)
    return out.withColumn("har", F.when(F.col("har") > 0, F.col("har"))) if positive else out


def har_next(df: DataFrame, c: str = "range", window: int | None = 800, least: int = 24) -> DataFrame:
    """One row for each asset: the forecast of the bar after its last one, with coefficients."""
    nxt = df.groupBy("asset").agg(F.max("ts").alias("ts")).select("asset", (F.col("ts") + 1).alias("ts"), F.lit(None).cast("double").alias(c))
    rows = df.select("asset", "ts", c).unionByName(nxt)
    out = har(rows, c, window, least)
    return out.join(nxt.select("asset", "ts"), ["asset", "ts"], "left_semi").select("asset", "n_obs", "beta", "har")


def baselines(df: DataFrame, c: str = "range", ewma_span: int = 22, ewma_context: int = 512) -> DataFrame:
    """df with prev, mean5, mean22 and ewma forecasts of c; the last is seeded by the first of the `ewma_context` values before.

    Such a mean is the one over the whole past, with the part of what lies before its context taken out: what the mean and the value
    there differ by, times the weight that is left of it. The values that count are those that aren't NULL."""
    whole = blocks.ema(df, c, ewma_span, "_e")
    left = F.lit((1.0 - 2.0 / (ewma_span + 1)) ** (ewma_context - 1))

    def near(x: DataFrame) -> DataFrame:
        seed = F.coalesce(left * (t.lag(c, ewma_context) - t.lag("_e", ewma_context)), F.lit(0.0))
        return x.withColumns({"prev": t.lag(c), "mean5": t.mean(c, 5, 1), "mean22": t.mean(c, 22, 1), "ewma": t.lag("_e") + seed})

    return blocks.bounded(whole, near, max(ewma_context, 23)).drop("_e")


def close_baselines(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """bars with persistence_close, previous_return (close[-1] / close[-1-h] - 1) and actual_return at the horizon."""
    base = t.lag("close")
    return bars.withColumns({"persistence_close": base, "previous_return": F.try_divide(base, t.lag("close", 1 + horizon)) - 1, "actual_return": F.try_divide(t.lead("close", horizon - 1) if horizon > 1 else F.col("close"), base) - 1})


def extrapolation(c: str = "close") -> Column:
    """The straight line through the last two values."""
    return 2 * t.lag(c, 1) - t.lag(c, 2)


def bias_correction(df: DataFrame, error: str, width_ms: int = 7 * DAY_MS, least: int = 24) -> DataFrame:
    """asset, bias: mean error of the last days before the newest row; NULL under `least` rows."""
    newest = F.max("ts").over(Window.partitionBy("asset"))
    rows = df.filter(F.col(error).isNotNull()).withColumn("_n", newest).filter(F.col("ts") > F.col("_n") - width_ms)
    return rows.groupBy("asset").agg(F.when(F.count(error) >= least, F.avg(error)).alias("bias"), F.count(error).alias("n"))


def ema(df: DataFrame, c: str, span: int, name: str) -> DataFrame:
    """df with the exponential mean over a series' whole past, seeded by its first value."""
    return blocks.ema(df, c, span, name)


def tercile_regime(value: Column, low: Column, high: Column, unknown: str = "unknown") -> Column:
    return F.when(value.isNull() | low.isNull(), unknown).when(value < low, "low").when(value > high, "high").otherwise("medium")


def regime_of_means(df: DataFrame, c: str = "range", measure: int = 22, context: int = 491, least: int = 2) -> DataFrame:
    """df with regime: the last mean of `measure` past values among the terciles of its own past (undefined under `least` means)."""
    own = blocks.bounded(blocks.placed(df), lambda x: x.withColumn("_m", t.mean(c, measure, 1)), measure + 1)
    own = blocks.quantiles(own, "_m", {"_lo": 1 / 3, "_hi": 2 / 3}, context, 0, least)
    return own.withColumn("regime", tercile_regime(F.col("_m"), F.col("_lo"), F.col("_hi"), "undefined")).drop("_m", "_lo", "_hi", blocks.AT)


def regime_of_forecast(df: DataFrame, forecast: str, c: str = "range", context: int = 720, least: int = 100) -> DataFrame:
    """df with regime: the forecast among the terciles of the last `context` past values."""
    own = blocks.quantiles(df, c, {"_lo": 1 / 3, "_hi": 2 / 3}, context, 1, least)
    return own.withColumn("regime", tercile_regime(F.col(forecast), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def regime_rolling(df: DataFrame, c: str, width: int, least: int, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """df with regime: each value among the quantiles of a window that it ends."""
    own = blocks.quantiles(df, c, {"_lo": low, "_hi": high}, width, 0, least)
    return own.withColumn("regime", tercile_regime(F.col(c), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def regime_zvol(bars: DataFrame, short: int = 168, long: int = 2160, fast: int = 480, slow: int = 1200, least_share: float = 1.0) -> DataFrame:
    """bars with vol_z, vol_regime (low, normal, high by its z-score) and trend_regime (fast against slow mean)."""
    r = F.when((F.col("close") > 0) & (t.lag("close") > 0), F.log(F.try_divide(F.col("close"), t.lag("close"))))
    need = lambda w: max(2, int(w * least_share))
    own = bars.withColumn("_r", r).withColumn("_v", t.std("_r", short, 0, need(short)))
    own = own.withColumn("vol_z", F.try_divide(F.col("_v") - t.mean("_v", long, 0, need(long)), t.std("_v", long, 0, need(long))))
    label = F.when(F.col("vol_z").isNull(), "unknown").when(F.col("vol_z") > 1, "high").when(F.col("vol_z") < -1, "low").otherwise("normal")
    a, b = t.mean("close", fast, 0, need(fast)), t.mean("close", slow, 0, need(slow))
    trend = F.when(a.isNull() | b.isNull(), "unknown").when(a > b, "up").otherwise("down")
    return own.withColumn("vol_regime", label).withColumn("trend_regime", trend).drop("_r", "_v")


def regime_fixed(vol: Column, low: float = 0.01, high: float = 0.03) -> Column:
    return F.when(vol.isNull(), "unknown").when(vol < low, "low").when(vol < high, "medium").otherwise("high")


def stale_regime(regime: Column, age_hours: Column, most: float = 2.0) -> Column:
    """The regime, or `unknown` if what it rests on is too old."""
    return F.when(age_hours.isNull() | (age_hours > most), "unknown").otherwise(F.coalesce(regime, F.lit("unknown")))


def stop_distance(prediction: Column, close: Column, multiplier: float, low: float = 0.005, high: float = 0.2, missing: float = 0.05) -> Column:
    """A stop as a share of the price: multiplier * prediction / close within bounds."""
    d = F.try_divide(multiplier * prediction, close)
    return F.when(d.isNull(), missing).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), d)))


def daily_realized(bars: DataFrame) -> DataFrame:
    """asset, ts (day), rv: sum of squared log returns of each day."""
    prev = t.lag("close")
    r = F.when((F.col("close") > 0) & (prev > 0), F.log(F.try_divide(F.col("close"), prev)))
    return bars.select("asset", (F.floor(F.col("ts") / F.lit(DAY_MS)) * DAY_MS).cast("long").alias("day"), r.alias("r")).groupBy("asset", "day").agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count("r").alias("n")).withColumnRenamed("day", "ts")


def har_rv(bars: DataFrame, window: int = 90, least: int = 30) -> DataFrame:
    """Daily volatility forecast: a trailing fit of rv on its 1, 5 and 22 day means, as a root of at least 1e-12."""
    out = har(daily_realized(bars), "rv", window, least)
    return out.withColumn("vol", F.sqrt(F.greatest(F.col("har"), F.lit(1e-12))))


def forecast_quality(df: DataFrame, forecast: str) -> DataFrame:
    """Coverage and spread of a forecast column for each asset."""
    f = F.col(forecast)
    return df.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count(f).alias("valid"), F.try_divide(F.count_if(f.isNull()).cast("double"), F.count(F.lit(1))).alias("null_rate"), F.avg(f).alias("mean"), F.median(f).alias("median"), F.min(f).alias("least"), F.max(f).alias("most"), F.count_if(f < 0).alias("negative"))
