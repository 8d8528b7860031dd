"""Feature matrices: own, cross-asset and settlement features, all from rows before the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.operators.asof import interval_mean, shifted
from tidemark.operators.forecast import har_terms, ranges
from tidemark.schema import DAY_MS, HOUR_MS


def log_return(c: str = "close", n: int = 1) -> Column:
    past = t.lag(c, n)
    return F.when((F.col(c) > 0) & (past > 0), F.log(F.try_divide(F.col(c), past)))


def normalized_range(bars: DataFrame) -> DataFrame:
    """bars with range and nr (range over close)."""
    return ranges(bars).withColumn("nr", F.try_divide("range", "close"))


#: Names of the technical features, in order (fixed values).
TECHNICAL = (
    "ret_1 ret_2 ret_3 ret_5 ret_10 ret_22 abs_ret_1 abs_ret_5 abs_ret_22 sq_ret_1 sq_ret_22 nr_1 nr_mean_5 nr_mean_22 nr_std_5 nr_std_22 range_1 range_mean_5 range_mean_22 range_std_5 range_std_22 "
    "rv_5 rv_22 park_5 park_22 vol_ret vol_z22 logvol_mean22 vol_cv22 dist_ma22 pos_range22 hour dow"
).split()


#: Rows before a row that its technical features rest on: 22 values, shifted by one, of returns on the row before.
REACH = 24


def technical(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """bars with the TECHNICAL features and target_norm; those of a row describe the bars before it (hour and weekday: the row's own time).

    Returns are simple ones; ranges are normalised by the close before; means need one value, deviations two. No feature reaches back further
    than REACH rows, so long series are dealt over blocks."""
    return blocks.bounded(bars, _technical, REACH, rows=rows)


def _technical(bars: DataFrame) -> DataFrame:
    last = t.lag("close")
    own = ranges(bars).withColumns({"target_norm": F.try_divide(F.col("high") - F.col("low"), last), "_r": F.try_divide("close", last) - 1, "_pk": s.parkinson(F.col("high"), F.col("low")), "_dv": F.try_divide("volume", t.lag("volume")) - 1})
    mean = lambda c, w, least=1: t.mean(c, w, 1, least)
    deviation = lambda c, w: t.std(c, w, 1, 2)
    low, high, at = t.low("close", 22, 1, 1), t.high("close", 22, 1, 1), F.timestamp_millis("ts")
    made = {f"ret_{n}": F.try_divide(last, t.lag("close", n + 1)) - 1 for n in (1, 2, 3, 5, 10, 22)}
    for c, name in (("target_norm", "nr"), ("range", "range")):
        made |= {f"{name}_1": t.lag(c)} | {f"{name}_mean_{w}": mean(c, w) for w in (5, 22)} | {f"{name}_std_{w}": deviation(c, w) for w in (5, 22)}
    made |= {f"rv_{w}": deviation("_r", w) for w in (5, 22)} | {f"park_{w}": F.sqrt(mean("_pk", w)) for w in (5, 22)}
    made |= {
        "vol_ret": t.lag("_dv"), "vol_z22": F.try_divide(t.lag("volume") - mean("volume", 22, 2), deviation("volume", 22)), "logvol_mean22": F.log1p(mean("volume", 22, 2)),
        "vol_cv22": F.try_divide(deviation("volume", 22), mean("volume", 22, 2)), "dist_ma22": F.try_divide(last, mean("close", 22)) - 1, "pos_range22": F.try_divide(last - low, high - low),
        "hour": F.hour(at), "dow": F.weekday(at),
    }
    own = own.withColumns(made)
    own = own.withColumns({f"abs_ret_{n}": F.abs(f"ret_{n}") for n in (1, 5, 22)} | {f"sq_ret_{n}": F.col(f"ret_{n}") * F.col(f"ret_{n}") for n in (1, 22)})
    return own.drop("_r", "_pk", "_dv")


def cross_features(bars: DataFrame) -> DataFrame:
    """asset, ts, nr, rv22 (sample deviation of 22 log returns), ret1 and ret22, of the bar itself."""
    own = normalized_range(bars).withColumn("ret1", log_return())
    return own.select("asset", "ts", "nr", t.std("ret1", 22).alias("rv22"), "ret1", log_return(n=22).alias("ret22"))


def cross_asset(target: DataFrame, other: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """target bars with the other asset's features of exactly one step before, and matched."""
    return shifted(target, cross_features(other).drop("asset"), ["nr", "rv22", "ret1", "ret22"], step_ms)


def settlement(bars: DataFrame, events: DataFrame, by: list[str], width_ms: int = DAY_MS, stale_ms: int = 8 * HOUR_MS) -> DataFrame:
    """bars with the range terms of an autoregression and the mean settlement rate of the last day (NULL if stale)."""
    own = har_terms(normalized_range(bars), "nr")
    return interval_mean(own, events, "rate", width_ms, stale_ms, by, "funding_24h")


def event_mean(events: DataFrame, width: int, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """events with rate_ma: mean of the last `width` rates, itself included."""
    return events.withColumn("rate_ma", t.mean("rate", width, 0, 1, by=by))


def context_volatility(length: int) -> Column:
    """Population deviation of the returns within the `length` bars before each row. Needs a column ret (close / previous close - 1)."""
    return F.when(F.count("ret").over(t.frame(-(length - 1), -1)) >= length - 1, F.stddev_pop("ret").over(t.frame(-(length - 1), -1)))
