"""Robustness of a strategy: rolling walk-forward quality, survival of costs, stability of single parameters, stops over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost multipliers of a stress curve, shares by which a parameter is moved, stop multipliers of a full sweep.
COSTS = (1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5)
MOVES = (-0.2, -0.1, 0.1, 0.2)
STOPS = (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0)

#: Plain strategies that a funnel is diagnosed with (crossing means, channels, relative strength, rates of change).
BASELINES = [
    {"name": "trend_10_50", "family": "trend", "fast": 10, "slow": 50, "threshold": 1.0, "hold": 24},
    {"name": "trend_20_100", "family": "trend", "fast": 20, "slow": 100, "threshold": 1.0, "hold": 24},
    {"name": "trend_50_200", "family": "trend", "fast": 50, "slow": 200, "threshold": 1.0, "hold": 24},
    {"name": "breakout_20", "family": "breakout", "fast": 10, "slow": 20, "threshold": 1.0, "hold": 24},
    {"name": "breakout_48", "family": "breakout", "fast": 10, "slow": 48, "threshold": 1.0, "hold": 24},
    {"name": "breakout_96", "family": "breakout", "fast": 10, "slow": 96, "threshold": 1.0, "hold": 24},
    {"name": "strength_14_30", "family": "rsi", "fast": 7, "slow": 14, "threshold": 30.0, "hold": 24},
    {"name": "strength_7_20", "family": "rsi", "fast": 5, "slow": 7, "threshold": 20.0, "hold": 24},
    {"name": "strength_21_40", "family": "rsi", "fast": 10, "slow": 21, "threshold": 40.0, "hold": 24},
    {"name": "momentum_14", "family": "momentum", "fast": 14, "slow": 50, "threshold": 0.0, "hold": 24},
    {"name": "momentum_48", "family": "momentum", "fast": 48, "slow": 100, "threshold": 2.0, "hold": 24},
]


def forward_windows(df: DataFrame, window: int, step: int, by: list[str] | None = None, periods: float = 8760.0) -> DataFrame:
    """by, test (from 0), total_return, sharpe (annualised), max_drawdown and entries of each test window of `step` bars after
    a training window of `window` bars; df: ret (of each bar) and entry. A window without an entry counts as flat."""
    by = by or ["asset"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ts")) - 1
    rows = df.withColumn("test", F.floor((place - window) / F.lit(step))).filter("test >= 0")
    w = Window.partitionBy(*by, "test").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("_e", F.exp(F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w)))
    fallen = grown.withColumn("_d", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)) - 1)
    out = fallen.groupBy(*by, "test").agg((F.max_by("_e", "ts") - 1).alias("_r"), (F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * periods**0.5).alias("_s"), F.min("_d").alias("_d"), F.count_if("entry").alias("entries"))
    some = lambda c: F.when(F.col("entries") > 0, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return out.select(*by, "test", some("_r").alias("total_return"), some("_s").alias("sharpe"), some("_d").alias("max_drawdown"), "entries")


def forward_quality(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, figures over test windows, quality (0 to 10: consistency 3, expectancy 3, ratio 2, drawdown 2, less 5 for a catastrophe) and passed."""
    r, c = F.col("total_return") * 100, F.col
    out = windows.groupBy(*(by or ["asset"])).agg(
        F.count(F.lit(1)).alias("windows"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.min(r).alias("worst_return"),
        F.min(F.col("max_drawdown") * 100).alias("worst_drawdown"), F.try_divide(F.avg(r), F.stddev_pop(r)).alias("oos_sharpe"), F.avg("sharpe").alias("_s"),
    )
    within = lambda x, most: F.least(F.lit(most), F.greatest(F.lit(0.0), x))
    points = within((c("win_rate") - 0.3) * 6, 3.0) + within(c("mean_return") / 5, 3.0) + within(c("_s"), 2.0) + within((20 + c("worst_drawdown")) / 10, 2.0)
    out = out.withColumn("quality", F.greatest(F.lit(0.0), points - F.when(c("worst_return") < -25, 5.0).otherwise(0.0)))
    return out.withColumn("oos_sharpe", F.coalesce("oos_sharpe", F.lit(0.0))).withColumn("passed", (c("quality") >= 3) & (c("win_rate") >= 0.4)).drop("_s")


def cost_survival(curve: DataFrame, by: list[str] | None = None, least: float = 1.5) -> DataFrame:
    """by, survival (the greatest cost multiplier with a profit, 0 without any) and passed. curve: multiplier, total_return."""
    out = curve.groupBy(*(by or ["asset"])).agg(F.coalesce(F.max(F.when(F.col("total_return") > 0, F.col("multiplier"))), F.lit(0.0)).alias("survival"))
    return out.withColumn("passed", F.col("survival") >= least)


def one_at_a_time(params: dict, moves: tuple[float, ...] = MOVES) -> list[tuple[str, dict]]:
    """(moved parameter, all parameters) for each number moved by each share alone; whole numbers stay whole, and moves that change nothing are left out."""
    out = []
    for name, value in params.items():
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            for move in moves:
                moved = value * (1 + move)
                moved = int(round(moved)) if isinstance(value, int) else moved
                if moved != value:
                    out.append((name, params | {name: moved}))
    return out


def parameter_stability(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, runs, score (10 less five deviations of the variants' Sharpe ratios), flag and passed. runs: sharpe (NULL: it never traded)."""
    out = runs.filter("sharpe IS NOT NULL").groupBy(*(by or ["asset"])).agg(F.count(F.lit(1)).alias("runs"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("_d"))
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - 5 * F.col("_d"))))
    flag = F.when((F.col("score") < 4) | (F.col("mean_sharpe") < 0), "FRAGILE").when(F.col("score") < 7, "MODERATELY_STABLE").otherwise("STABLE")
    return out.withColumn("flag", flag).withColumn("passed", F.col("flag") != "FRAGILE").drop("_d")


def sweep_verdict(sweep: DataFrame, best: Column | float, periods: DataFrame, p_value: float | None, alpha: float = 0.1, least_trades: int = 30) -> DataFrame:
    """One row with G1 to G6 and overall of a stop study over all assets. sweep: asset, multiplier (0: the fixed stop), n, sharpe, max_drawdown;
    best: the multiplier judged; periods: asset, total_return of each period with it. G1: a better Sharpe ratio for every asset; G2: a lesser
    drawdown; G3: enough trades; G4: two profitable periods; G5: a positive Sharpe ratio; G6: the p-value."""
    own = sweep.filter(F.col("multiplier") == best)
    base = sweep.filter("multiplier = 0").select("asset", F.col("sharpe").alias("_s"), F.col("max_drawdown").alias("_d"))
    each = own.join(base, "asset").join(periods.groupBy("asset").agg(F.count_if(F.col("total_return") > 0).alias("_p")), "asset", "left")
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    out = each.agg(
        every(F.col("sharpe") > F.col("_s")).alias("G1"), every(F.abs("max_drawdown") < F.abs("_d")).alias("G2"), every(F.col("n") >= least_trades).alias("G3"),
        every(F.col("_p") >= 2).alias("G4"), every(F.col("sharpe") > 0).alias("G5"), F.lit(p_value is not None and p_value < alpha).alias("G6"),
    )
    passed = F.col("G1") & F.col("G2") & F.col("G3") & F.col("G4") & F.col("G5") & F.col("G6")
    return out.withColumn("overall", F.when(passed, "PASS").otherwise("OPTION_C"))
