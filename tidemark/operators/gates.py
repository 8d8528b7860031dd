"""Declarative pass/fail gates: named conditions over one aggregated row, all or nothing."""

from __future__ import annotations

import hashlib
import json
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(df: DataFrame, checks: dict[str, Column], verdicts: tuple[str, str] = ("pass", "fail")) -> DataFrame:
    """df with a boolean for each check (NULL counts as failing), passed (how many) and verdict."""
    out = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    passed = sum((F.col(k).cast("int") for k in checks), F.lit(0))
    return out.withColumn("passed", passed).withColumn("verdict", F.when(F.col("passed") == len(checks), verdicts[0]).otherwise(verdicts[1]))


def direction_gates(stats: DataFrame, hit: float = 0.55, alpha: float = 0.05, least_n: int = 30, fall: float = 0.1) -> DataFrame:
    """Gates of a direction study over columns hit_rate, worst_asset (its hit rate), p_value, worst_window, older, recent and least_n (events of the
    asset with the fewest): hit rate overall and of each asset, significance, every asset over a half, every third over a half, no fall, enough events."""
    return gate(stats, {
        "G1": (F.col("hit_rate") > hit) & (F.col("worst_asset") > hit), "G2": F.col("p_value") < alpha, "G3": F.col("worst_asset") > 0.5,
        "G4": F.col("worst_window") > 0.5, "G5": F.col("recent") >= F.col("older") - fall, "G6": F.col("least_n") >= least_n,
    }, ("SIGNAL FOUND", "CLOSED"))


def _over_half(flag: str) -> Column:
    return F.count_if(F.col(flag)) * 2 > F.count(F.lit(1))


def _breadth(records: DataFrame, key: str, flag: str, name: str, wins: int = 2) -> DataFrame:
    """One row: in how many groups of a key the flag holds `wins` times or more."""
    return records.groupBy(key).agg(F.count_if(F.col(flag)).alias("_w")).agg(F.count_if(F.col("_w") >= wins).alias(name))


def _pooled(dm: DataFrame, alpha: float) -> DataFrame:
    """One row: whether the pooled test favours the primary model (a lower loss, p under alpha), by its numbers alone."""
    return dm.select(((F.col("p_value") < alpha) & (F.col("mean_diff") < 0)).alias("_dm"))


def breadth_gate(records: DataFrame, dm: DataFrame, regimes: DataFrame, alpha: float = 0.0125, breadth: str = "beats_base", seventh: Column | None = None) -> DataFrame:
    """One row with c1 to c8 and the verdict of a forecast study.

    records: a row for each window of a series (series, window, low_power, beats_base, beats_second, beats_norm, tracks); dm: the pooled test;
    regimes: a row for each regime (beats_base). c1, c2, c5, c7: over half of the windows (seventh: another condition for c7 over the
    records); c3, c4: two series, two windows with two wins each; c6: the pooled test; c8: two regimes. Windows of low power don't
    count. A: all hold; B: c1 does; C: it doesn't; pending: no window counts."""
    rows = records.filter(~F.col("low_power"))
    one = rows.agg(F.count(F.lit(1)).alias("eligible"), *(_over_half(f).alias(f"_{f}") for f in ("beats_base", "beats_second", "beats_norm")), (_over_half("tracks") if seventh is None else seventh).alias("_c7"))
    # each side is one aggregated row
    one = one.join(_breadth(rows, "series", breadth, "_series")).join(_breadth(rows, "window", breadth, "_windows")).join(_pooled(dm, alpha).limit(1), how="left").join(regimes.agg(F.count_if(F.col("beats_base")).alias("_regimes")))
    out = gate(one, {
        "c1": F.col("_beats_base"), "c2": F.col("_beats_second"), "c3": F.col("_series") >= 2, "c4": F.col("_windows") >= 2,
        "c5": F.col("_beats_norm"), "c6": F.col("_dm"), "c7": F.col("_c7"), "c8": F.col("_regimes") >= 2,
    })
    verdict = F.when(F.col("eligible") == 0, "pending").when(F.col("passed") == 8, "A").when(F.col("c1"), "B").otherwise("C")
    return out.withColumn("verdict", verdict).select("eligible", *(f"c{i}" for i in range(1, 9)), "passed", "verdict")


def asset_gate(records: DataFrame, dm: DataFrame, regimes: DataFrame, assets: int = 2, alpha: float = 0.05) -> DataFrame:
    """One row with c1 to c7 and the verdict of a study of added features.

    records: a row for each window of an asset (asset, low_power, beats_norm, beats_norm_rmse, beats_base, leaks). c1: two of three windows
    of any asset; c2, c3: of all `assets`, by mean and by squared errors; c4: over half of the windows unnormalised; c5: the pooled
    test; c6: two regimes; c7: no leaks. PASS: all hold; B: c1 does; C: it doesn't; pending: no window counts."""
    rows = records.filter(~F.col("low_power"))
    enough = lambda f: (F.count(F.lit(1)) >= 3) & (F.count_if(F.col(f)) >= 2)
    each = rows.groupBy("asset").agg(enough("beats_norm").alias("m"), enough("beats_norm_rmse").alias("r")).agg(F.count_if(F.col("m")).alias("_m"), F.count_if(F.col("r")).alias("_r"))
    one = rows.agg(F.count(F.lit(1)).alias("eligible"), _over_half("beats_base").alias("_raw"), (F.sum("leaks") == 0).alias("_clean"))
    one = one.join(each).join(_pooled(dm, alpha).limit(1), how="left").join(regimes.agg(F.count_if(F.col("beats_base")).alias("_regimes")))  # one row each
    out = gate(one, {
        "c1": F.col("_m") >= 1, "c2": F.col("_m") >= assets, "c3": F.col("_r") >= assets, "c4": F.col("_raw"),
        "c5": F.col("_dm"), "c6": F.col("_regimes") >= 2, "c7": F.col("_clean"),
    })
    verdict = F.when(F.col("eligible") == 0, "pending").when(F.col("passed") == 7, "PASS").when(F.col("c1"), "B").otherwise("C")
    return out.withColumn("verdict", verdict).select("eligible", *(f"c{i}" for i in range(1, 8)), "passed", "verdict")


def portfolio_gates(candidate: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """Gates of a candidate's metrics against a baseline's; drawdowns are non-positive, so a lesser size is better."""
    base = baseline.select(*key, *(F.col(c).alias(f"base_{c}") for c in ("sharpe", "max_drawdown", "total_return", "win_rate", "profit_factor")))
    return gate(candidate.join(base, key), {
        "G1": F.col("sharpe") > F.col("base_sharpe"), "G2": F.abs("max_drawdown") < F.abs("base_max_drawdown"), "G3": F.col("total_return") > 0,
        "G4": F.col("win_rate") >= F.col("base_win_rate"), "G5": F.coalesce("profit_factor", F.lit(0.0)) > 1, "G6": F.col("n") >= 30,
    })


def risk_checks(orders: DataFrame, max_drawdown: float = 0.2, max_daily_loss: float = 0.05, max_positions: int = 3, max_exposure: float = 1.0, cooldown_ms: int = 3_600_000) -> DataFrame:
    """orders (side, ts, equity, exposure, drawdown, daily_pnl, open_positions, last_ts) with reason: the first rule that holds one back, or APPROVED."""
    c = F.col
    return orders.withColumn("reason", F.when(c("side") == "HOLD", "HOLD").when(c("equity") <= 0, "INSUFFICIENT_BALANCE").when(c("drawdown") >= max_drawdown, "MAX_DRAWDOWN").when(c("daily_pnl") <= -c("equity") * max_daily_loss, "MAX_DAILY_LOSS").when(c("open_positions") >= max_positions, "MAX_POSITIONS").when(c("exposure") >= max_exposure, "MAX_EXPOSURE").when(c("last_ts").isNotNull() & (c("ts") - c("last_ts") < cooldown_ms), "COOLDOWN").otherwise("APPROVED"))


def sweep_gates(sweep: DataFrame, best: DataFrame, alpha: float = 0.05) -> DataFrame:
    """asset and gates of its best multiplier against multiplier 0: better Sharpe ratio, better mean, better win rate, enough trades, profit, and a
    mean above 0 that is significant at alpha (two-sided, by the normal distribution)."""
    base = sweep.filter("multiplier = 0").select("asset", *(F.col(c).alias(f"base_{c}") for c in ("sharpe", "mean_pnl", "win_rate")))
    rows = sweep.join(best, ["asset", "multiplier"]).join(base, "asset")
    return gate(rows, {
        "G1": F.col("sharpe") > F.col("base_sharpe"), "G2": F.col("mean_pnl") > F.col("base_mean_pnl"), "G3": F.col("win_rate") >= F.col("base_win_rate"),
        "G4": F.col("n") >= 30, "G5": F.col("profit_factor") > 1, "G6": F.col("t_stat") > NormalDist().inv_cdf(1 - alpha / 2),
    })


def lock(result: dict) -> str:
    """SHA-256 of a result's JSON with sorted keys: stored beside a frozen result and compared before it is replaced."""
    return hashlib.sha256(json.dumps(result, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def envelope(rows: DataFrame, config: dict) -> DataFrame:
    """One row: the rows as a sorted array of JSON, and the hash of the settings they were made with. rows must be a short report."""
    return rows.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns)))).alias("rows")).withColumn("config_hash", F.lit(lock(config)))


def progress(history: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """asset, day (from 1, since the oldest row), progress_pct."""
    day = F.floor((F.lit(now_ms) - F.min("ts")) / 86_400_000.0) + 1
    return history.groupBy("asset").agg(day.cast("long").alias("day")).withColumn("progress_pct", F.least(F.lit(100.0), F.col("day") * 100.0 / days))
