"""Bars: resampling, dense grids, closing rules, canonical rows.

A bar is (asset, ts, open, high, low, close, volume); ts is its open time in epoch ms
UTC. All functions map DataFrames to DataFrames and stay lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import ts as t
from tidemark.operators import ordered
from tidemark.schema import HOUR_MS, require_columns

PRICES = ("open", "high", "low", "close")


def resample(ticks: DataFrame, asset: Column, ms: Column, price: Column, sequence: Column | None = None, volume: Column | None = None, width_ms: int = HOUR_MS) -> DataFrame:
    """Bars of raw ticks: first, greatest, least and last price by sequence (the time, if not given), and volume (the count).

    One partial aggregation and one shuffle of a row for each bar and task; hot assets cost nothing extra."""
    sequence = ms if sequence is None else sequence
    rows = ticks.select(asset.alias("asset"), (F.floor(ms / F.lit(width_ms)) * width_ms).cast("long").alias("ts"), price.cast("double").alias("_p"), sequence.alias("_s"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("_v"))
    return rows.groupBy("asset", "ts").agg(F.min_by("_p", "_s").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_s").alias("close"), F.sum("_v").alias("volume"))


def coarsen(bars: DataFrame, width_ms: int) -> DataFrame:
    """Bars of a wider frame from finer ones."""
    at = (F.floor(F.col("ts") / F.lit(width_ms)) * width_ms).cast("long")
    return bars.groupBy("asset", at.alias("wide")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("wide", "ts")


def closed(bars: DataFrame, now_ms: int, width_ms: int = HOUR_MS) -> DataFrame:
    """Bars that have ended by now_ms."""
    return bars.filter(F.col("ts") + width_ms <= now_ms)


def drop_newest(bars: DataFrame) -> DataFrame:
    """All but the newest bar of each asset, which may be forming."""
    newest = F.max("ts").over(Window.partitionBy("asset"))
    return bars.withColumn("_n", newest).filter("ts < _n").drop("_n")


def latest(bars: DataFrame, n: int, least: int = 0) -> DataFrame:
    """The newest n bars of each asset; with `least`, of those assets that have so many."""
    at = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    rows = bars.withColumn("_r", at)
    if least:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("asset"))).filter(F.col("_n") >= least).drop("_n")
    return rows.filter(F.col("_r") <= n).drop("_r")


def dense_grid(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Each asset's bars on an unbroken grid. A missing bar repeats the last close with no volume and has filled_gap = 1;
    rows off the grid are left out (see off_grid)."""
    grid = bars.filter(F.col("ts") % width_ms == 0)
    span = grid.groupBy("asset").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    full = span.select("asset", F.explode(F.sequence("a", "b", F.lit(width_ms))).alias("ts"))
    rows = full.join(grid, ["asset", "ts"], "left")
    close = F.last("close", ignorenulls=True).over(t.past())
    filled = rows.withColumn("filled_gap", F.col("close").isNull().cast("int")).withColumn("_c", close)
    return filled.select("asset", "ts", *(F.coalesce(c, "_c").alias(c) for c in PRICES), F.coalesce("volume", F.lit(0.0)).alias("volume"), "filled_gap")


def off_grid(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Rows whose time isn't a multiple of the width."""
    return bars.filter(F.col("ts") % width_ms != 0)


def on_grid(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    return bars.filter(F.col("ts") % width_ms == 0)


def infer_width(bars: DataFrame) -> DataFrame:
    """asset, median_ms, width_ms: the usual frame within 1 % of the median spacing, NULL if none is."""
    gaps = blocks.bounded(bars.select("asset", "ts"), lambda x: x.withColumn("d", F.col("ts") - t.lag("ts")), 1)
    median = ordered.with_quantiles(bars.select("asset").distinct(), ordered.quantiles(gaps, F.col("d"), ["asset"], {"median_ms": 0.5}), ["asset"])
    known = F.array(*(F.lit(m * 60_000) for m in (1, 5, 15, 30, 60, 240, 1440)))
    fit = F.filter(known, lambda w: F.abs(F.col("median_ms") - w) <= w * 0.01)
    return median.withColumn("width_ms", F.try_element_at(fit, F.lit(1)).cast("long"))


def dedup(rows: DataFrame, key: list[str], arrival: str, keep: str = "last") -> DataFrame:
    """One row for each key: the first or the last by arrival."""
    w = Window.partitionBy(*key).orderBy(F.asc(arrival) if keep == "first" else F.desc(arrival))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def canonical(raw: DataFrame, arrival: str = "seq") -> DataFrame:
    """Bars of raw rows whose columns may be text: rows that don't parse are dropped, the last of each time stays."""
    require_columns(raw, ["asset", "ts", *PRICES, "volume", arrival])
    cast = raw.select("asset", F.col("ts").try_cast("long").alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in (*PRICES, "volume")), arrival)
    return dedup(cast.dropna(subset=["ts", *PRICES]), ["asset", "ts"], arrival).drop(arrival)


def time_range(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows with start <= ts < end."""
    out = rows if start is None else rows.filter(F.col("ts") >= start)
    return out if end is None else out.filter(F.col("ts") < end)


def relative(bars: DataFrame) -> DataFrame:
    """Prices in units of each asset's first close."""
    first = F.first("close").over(t.order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumn("_f", first).select("asset", "ts", *(F.try_divide(F.col(c), "_f").alias(c) for c in PRICES), "volume")


def future_times(bars: DataFrame, n: int, width_ms: int = HOUR_MS) -> DataFrame:
    """The next n bar times of each asset."""
    newest = bars.groupBy("asset").agg(F.max("ts").alias("m"))
    return newest.select("asset", F.explode(F.sequence(F.col("m") + width_ms, F.col("m") + n * width_ms, F.lit(width_ms))).alias("ts"))


def daily_to_hourly(hourly: DataFrame, daily: DataFrame, value: str, day_ms: int = 86_400_000) -> DataFrame:
    """hourly with the day's value, carried on where a day has none."""
    own = hourly.withColumn("_day", (F.floor(F.col("ts") / F.lit(day_ms)) * day_ms).cast("long"))
    joined = own.join(daily.select("asset", F.col("ts").alias("_day"), F.col(value)), ["asset", "_day"], "left")
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(t.past())).drop("_day")
