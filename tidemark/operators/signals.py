"""Signals as columns: bar patterns, strategy families, sizes.

Patterns are shifted by one bar: a row's signal is known when its bar opens. NULL
conditions count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts as t

O, H, L, C, V = "open", "high", "low", "close", "volume"  # noqa: E741


def _c(name: str) -> Column:
    return F.col(name)


def shift(signal: Column) -> Column:
    """The signal one bar later, 0 where there is none."""
    return F.coalesce(F.lag(signal, 1).over(t.order()), F.lit(0))


def _flag(cond: Column, value: int = 1) -> Column:
    return F.when(cond, value).otherwise(0)


# Patterns ---------------------------------------------------------------------------------


def _steps(high_up: bool, steps: int) -> Column:
    cond = F.lit(True)
    for k in range(steps):
        a, b = (_c(x) if k == 0 else t.lag(x, k) for x in (H, L))
        pa, pb = t.lag(H, k + 1), t.lag(L, k + 1)
        cond = cond & ((a > pa) & (b > pb) if high_up else (a < pa) & (b < pb))
    return cond


def higher_highs(steps: int = 3) -> Column:
    """1 after `steps` bars with higher highs and higher lows."""
    return _flag(_steps(True, steps))


def lower_lows(steps: int = 3) -> Column:
    return _flag(_steps(False, steps), -1)


def momentum(steps: int = 3) -> Column:
    return higher_highs(steps) + lower_lows(steps)


def fade(steps: int = 3) -> Column:
    """Against the momentum."""
    return -momentum(steps)


def engulfing() -> Column:
    """1 where a rising body engulfs the falling one before, -1 the other way."""
    po, pc = t.lag(O), t.lag(C)
    other = (_c(O) != pc) | (_c(C) != po)  # the same body again is no pattern
    up = (pc < po) & (_c(C) > _c(O)) & (_c(O) <= pc) & (_c(C) >= po) & other
    down = (pc > po) & (_c(C) < _c(O)) & (_c(O) >= pc) & (_c(C) <= po) & other
    return F.when(up, 1).when(down, -1).otherwise(0)


def doji(most: float = 0.1) -> Column:
    """1 where the body is under a share of the range (and there is one)."""
    return _flag((_c(H) > _c(L)) & (F.try_divide(F.abs(_c(C) - _c(O)), _c(H) - _c(L)) < most))


def hammer(shadow: float = 2.0, upper: float = 0.5, place: float = 0.7) -> Column:
    """1 where the lower shadow is over `shadow` bodies, the upper one under `upper` bodies, and the body high in the range."""
    body, span = F.abs(_c(C) - _c(O)), _c(H) - _c(L)
    return _flag((body > 0) & (span > 0) & (F.least(O, C) - _c(L) > shadow * body) & (_c(H) - F.greatest(O, C) < upper * body) & (F.least(O, C) >= _c(L) + place * span))


def volume_ratio(width: int = 20) -> Column:
    m = t.mean(V, width)
    return F.try_divide(_c(V), F.when(m != 0, m))


def volume_spike(width: int = 20, times: float = 2.0) -> Column:
    """Direction of the body of bars whose volume is over `times` the mean."""
    return F.when(volume_ratio(width) > times, F.signum(_c(C) - _c(O)).cast("int")).otherwise(0)


def forward_returns(bars: DataFrame, signal: str, horizon: int = 1, keep_flat: bool = False) -> DataFrame:
    """asset, ts, signal, forward_return (over the horizon), correct: rows with a signal (keep_flat: all) and a known future.
    A return of exactly 0 is never correct."""
    rows = bars.withColumn("forward_return", F.try_divide(t.lead(C, horizon), _c(C)) - 1).filter(_c("forward_return").isNotNull())
    if not keep_flat:
        rows = rows.filter(F.coalesce(_c(signal), F.lit(0)) != 0)
    return rows.select("asset", "ts", _c(signal).alias("signal"), "forward_return", (F.signum("forward_return") == F.signum(signal)).cast("int").alias("correct"))


def hour_bias(bars: DataFrame, part: str = "hour") -> DataFrame:
    """asset, slot, mean_return, win_rate, n for every hour (or weekday, Monday 0), NULL where a slot has no returns."""
    at = F.timestamp_millis("ts")
    ret = F.try_divide(_c(C), t.lag(C)) - 1
    rows = bars.select("asset", (F.hour(at) if part == "hour" else F.weekday(at)).alias("slot"), ret.alias("r")).dropna()
    found = rows.groupBy("asset", "slot").agg(F.avg("r").alias("mean_return"), F.avg((_c("r") > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("n"))
    slots = bars.select("asset").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(23 if part == "hour" else 6))))
    return slots.join(found, ["asset", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def best_hours(bars: DataFrame, least_rate: float = 0.55, least: int = 100, train_share: float = 0.6) -> DataFrame:
    """Hours of a win rate over least_rate from more than `least` returns in each asset's first share of bars, the best first (of equal ones the earlier)."""
    place = F.row_number().over(t.order())
    total = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    train = bars.withColumn("_p", place).withColumn("_n", total).filter(_c("_p") <= F.floor(_c("_n") * train_share)).drop("_p", "_n")
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("win_rate"), F.asc("slot")))
    return hour_bias(train).filter((_c("n") > least) & (_c("win_rate") > least_rate)).withColumn("place", rank)


def hour_signal(bars: DataFrame, hours: DataFrame) -> DataFrame:
    """bars with signal: 1 at an hour of the asset's set."""
    own = bars.withColumn("slot", F.hour(F.timestamp_millis("ts")))
    return own.join(hours.select("asset", "slot", F.lit(1).alias("signal")), ["asset", "slot"], "left").withColumn("signal", F.coalesce("signal", F.lit(0))).drop("slot")


# Strategy families ----------------------------------------------------------------------------


def breakout_entry(width: int = 20, times: float = 2.0) -> Column:
    """Range over `times` its mean."""
    r = _c(H) - _c(L)
    return t.true(r > times * t.mean(r, width))


def channel_exit(width: int = 10, c: str = C, least: int | None = None) -> Column:
    """Close under the lowest close (or another column) of the bars before."""
    return t.true(_c(C) < t.low(c, width, 1, least))


def donchian(width: int = 20) -> Column:
    """1 over the channel of the bars before, -1 under it."""
    return F.when(t.true(_c(C) > t.high(H, width, 1)), 1).when(t.true(_c(C) < t.low(L, width, 1)), -1).otherwise(0)


def volatility_expansion(df: DataFrame, width: int = 20, times: float = 1.5) -> DataFrame:
    """df with expansion: direction of bars that move more than `times` the mean true range before them."""
    own = atr(df, width, name="_atr").withColumn("_before", t.lag("_atr")).withColumn("_move", _c(C) - t.lag(C))
    return own.withColumn("expansion", F.when(t.true(F.abs("_move") > times * _c("_before")), F.signum("_move").cast("int")).otherwise(0)).drop("_atr", "_before", "_move")


def sma_cross(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """df with cross: 1 where the fast mean rises over the slow one, -1 where it falls under it."""
    own = df.withColumn("_f", t.mean(C, fast)).withColumn("_s", t.mean(C, slow))
    up, was = _c("_f") > _c("_s"), t.lag(_c("_f") > _c("_s"))
    return own.withColumn("cross", F.when(t.true(up & ~was), 1).when(t.true(~up & was), -1).otherwise(0)).drop("_f", "_s")


def rsi(df: DataFrame, width: int = 14, name: str = "rsi") -> DataFrame:
    """df with the relative strength index over plain means of gains and losses (100 without losses)."""
    own = df.withColumn("_d", _c(C) - t.lag(C))
    own = own.withColumn("_g", t.mean(F.greatest(_c("_d"), F.lit(0.0)), width)).withColumn("_l", t.mean(F.greatest(-_c("_d"), F.lit(0.0)), width))
    full = t.rolling(F.count, "_d", width)
    value = F.when(_c("_l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l")))
    return own.withColumn(name, F.when(full.isNotNull(), value)).drop("_d", "_g", "_l")


def zscore(c: str, width: int, least: int | None = None) -> Column:
    return F.try_divide(_c(c) - t.mean(c, width, 0, least), t.std(c, width, 0, least))


def roc(width: int = 10, c: str = C) -> Column:
    return F.try_divide(_c(c), t.lag(c, width)) - 1


def acceleration(width: int = 10, c: str = C) -> Column:
    """Rate of change less that of the window before."""
    return F.try_divide(_c(c), t.lag(c, width)) - F.try_divide(t.lag(c, width), t.lag(c, 2 * width))


def true_range() -> Column:
    pc = t.lag(C)
    return F.greatest(_c(H) - _c(L), F.abs(_c(H) - pc), F.abs(_c(L) - pc))


def atr(df: DataFrame, width: int = 14, least: int = 2, name: str = "atr") -> DataFrame:
    """df with the mean true range."""
    return df.withColumn("_tr", true_range()).withColumn(name, t.mean("_tr", width, 0, least)).drop("_tr")


def bollinger(width: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Middle, upper and lower band, by the population deviation."""
    m, d = t.mean(C, width), t.std_pop(C, width)
    return {"bb_mid": m, "bb_upper": m + k * d, "bb_lower": m - k * d}


def band_signals(df: DataFrame, width: int = 20, k: float = 2.0) -> DataFrame:
    """df with entry under the lower band and exit over the middle."""
    own = df.withColumns(bollinger(width, k))
    return own.withColumns({"entry": t.true(_c(C) < _c("bb_lower")), "exit": t.true(_c(C) > _c("bb_mid"))})


def rsi_signals(df: DataFrame, buy: float = 30, sell: float = 70, width: int = 14, trend: str | None = None, regimes: list[str] | None = None) -> DataFrame:
    """df with entry (RSI under buy, close above a trend column if named, in an allowed regime if given) and exit (RSI over sell)."""
    own = rsi(df, width)
    entry = _c("rsi") < buy
    if trend:
        entry = entry & (_c(C) > _c(trend))
    if regimes is not None:
        entry = entry & _c("regime").isin(regimes)
    return own.withColumns({"entry": t.true(entry), "exit": t.true(_c("rsi") > sell)})


def expansion_signals(df: DataFrame, times: float = 2.0, width: int = 20, exit_width: int = 10, trend: str | None = None, regimes: list[str] | None = None) -> DataFrame:
    """df with entry (a rising bar of an expanded range with volume, above a trend column if named, in an allowed regime) and exit (under the lowest low before)."""
    entry = breakout_entry(width, times) & (_c(C) > _c(O)) & (_c(V) > 0)
    if trend:
        entry = entry & (_c(C) > _c(trend))
    if regimes is not None:
        entry = entry & _c("regime").isin(regimes)
    return df.withColumns({"entry": t.true(entry), "exit": channel_exit(exit_width, L, 1)})


def contrarian(value: str, high: Column, low: Column) -> Column:
    """-1 where a value is over the high limit, 1 under the low one."""
    return F.when(t.true(_c(value) > high), -1).when(t.true(_c(value) < low), 1).otherwise(0)


def spread_z(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """df with spread (log ratio of two prices) and spread_z, from half the window on."""
    own = df.withColumn("spread", F.when((_c(a) > 0) & (_c(b) > 0), F.log(F.try_divide(_c(a), _c(b)))))
    return own.withColumn("spread_z", zscore("spread", width, width // 2))


def held(entry: str, bars: int) -> Column:
    """Exit `bars` after an entry."""
    return t.true(t.lag(entry, bars))


def clip(c: Column, low: float = 0.1, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def size_inverse_vol(target: float = 0.01, width: int = 24) -> Column:
    """Target over realised volatility, within bounds. Needs a column ret."""
    return clip(F.try_divide(F.lit(target), t.std("ret", width)))


def size_trend(width: int = 50) -> Column:
    """Distance from the mean in deviations, halved."""
    return clip(F.abs(zscore(C, width)) / 2)


def size_breakout(width: int = 20) -> Column:
    r = _c(H) - _c(L)
    return clip(F.try_divide(r, 3 * t.mean(r, width)))


def realized_regime(width: int = 24, long: int = 240) -> Column:
    """1 where short volatility is over the long median, else 0. Needs a column vol."""
    return _flag(t.true(_c("vol") > t.rolling(F.median, "vol", long, 0, width)))


def liquidation_bounce(drop: float = 0.05, times: float = 2.0, width: int = 24) -> Column:
    """1 after a fall beyond `drop` on a volume spike."""
    return _flag(t.true((roc(1) < -drop) & (volume_ratio(width) > times)))


def pair(bars: DataFrame, a: str, b: str, columns: tuple[str, ...] = (C,)) -> DataFrame:
    """One row for each time that both assets have, with their columns as a_ and b_."""
    left = bars.filter(_c("asset") == a).select("ts", *(_c(c).alias(f"a_{c}") for c in columns))
    right = bars.filter(_c("asset") == b).select("ts", *(_c(c).alias(f"b_{c}") for c in columns))
    return left.join(right, "ts").withColumn("asset", F.lit(f"{a}/{b}"))


def look_ahead_rows(bars: DataFrame, make, cut_ts: int, columns: list[str]) -> DataFrame:
    """Rows up to cut_ts whose signals change when all later bars are altered: none, unless the signal looks ahead."""
    altered = bars.withColumns({c: F.when(_c("ts") > cut_ts, _c(c) * 1.7 + 3).otherwise(_c(c)) for c in (O, H, L, C, V)})
    keep = ["asset", "ts", *columns]
    a, b = (make(x).filter(_c("ts") <= cut_ts).select(keep) for x in (bars, altered))
    return a.exceptAll(b).unionByName(b.exceptAll(a))
