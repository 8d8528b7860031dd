"""Strategy families: funding, sized moves, confirmed momentum, and filters that other signals take.

All are columns over bars sorted by asset and time. Entries are conditions with NULL as false; what
follows an entry (holding, opposite signals) is the position rule's business (`sim.sequentialize`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts as t
from tidemark.functions.scalars import clip

FLAGS = ("long_entry", "long_exit", "short_entry", "short_exit")


def flags(df: DataFrame, long: Column, short: Column, long_exit: Column | None = None, short_exit: Column | None = None) -> DataFrame:
    """df with the four columns that position rules read."""
    given = (long, F.lit(False) if long_exit is None else long_exit, short, F.lit(False) if short_exit is None else short_exit)
    return df.withColumns({name: t.true(c) for name, c in zip(FLAGS, given)})


def funding_contrarian(df: DataFrame, rate: str, low: float, high: float, flip: bool = False) -> DataFrame:
    """Long under the low rate, short over the high one; flip: out once the rate has changed its sign after any entry of that side."""
    r = F.col(rate)
    long, short = t.true(r < low), t.true(r > high)
    if not flip:
        return flags(df, long, short)
    seen = lambda c: F.max(c).over(t.past())
    own = df.withColumns({"_long": long, "_short": short}).withColumns({"_seen_long": seen(F.col("_long")), "_seen_short": seen(F.col("_short"))})
    return flags(own, F.col("_long"), F.col("_short"), (r > 0) & F.col("_seen_long"), (r < 0) & F.col("_seen_short")).drop("_long", "_short", "_seen_long", "_seen_short")


def funding_trend(df: DataFrame, rate_mean: str, threshold: float, confirm_width: int | None = None) -> DataFrame:
    """Long over the threshold of a mean rate, short under its negative; confirmed by the price against its own mean if a width is given."""
    r, long, short = F.col(rate_mean), F.lit(True), F.lit(True)
    if confirm_width:
        mean = t.mean("close", confirm_width, 0, 2)
        long, short = F.col("close") > mean, F.col("close") < mean
    return flags(df, (r > threshold) & long, (r < -threshold) & short)


def sized_moves(df: DataFrame, forecast: str, regime: str, allowed: list[str], times: float, fade: bool = False) -> DataFrame:
    """Moves of over `times` the forecast range, in allowed regimes: with the move, or against it (fade)."""
    move, limit, within = F.col("close") - t.lag("close"), times * F.col(forecast), F.col(regime).isin(allowed)
    up, down = (move > limit) & within, (move < -limit) & within
    return flags(df, down, up) if fade else flags(df, up, down)


def size_by_forecast(forecast: str, width: int, least: int, missing: float = 0.5) -> Column:
    """Median over the present forecast, within 0.1 and 1: smaller where more movement is expected."""
    return F.coalesce(clip(F.try_divide(t.quantile(forecast, 0.5, width, 0, least), F.col(forecast)), 0.1, 1.0), F.lit(missing))


def paired_momentum(df: DataFrame, lookback: int, threshold: float, own: str = "a_close", other: str | None = "b_close") -> DataFrame:
    """Momentum of one price beyond a threshold, confirmed by the sign of another's if there is one."""
    rate = lambda c: F.try_divide(F.col(c), t.lag(c, lookback)) - 1
    long, short = rate(own) > threshold, rate(own) < -threshold
    if other:
        long, short = long & (rate(other) > 0), short & (rate(other) < 0)
    return flags(df, long, short)


def volatility_regime(df: DataFrame, fast: int, slow: int, lookback: int, threshold: float, falling: bool = True, reversion: bool = True) -> DataFrame:
    """Long where the short volatility is under (falling) or over the long one and the price has dipped under its mean (reversion) or risen."""
    own = df.withColumn("_r", F.try_divide("close", t.lag("close")) - 1)
    quick, calm = t.std("_r", fast), t.std("_r", slow)
    moved = F.col("close") < t.mean("close", lookback) * (1 - threshold) if reversion else F.try_divide("close", t.lag("close", lookback)) - 1 > threshold
    return flags(own, (quick < calm if falling else quick > calm) & moved, F.lit(False)).drop("_r")


def interest_proxy(df: DataFrame, width: int, change: int, interest: float, price: float, confirm: bool = True) -> DataFrame:
    """Long where a sum of volume, standing for open interest, and the price have both risen (confirm) or both fallen beyond thresholds."""
    own = df.withColumn("_i", t.total("volume", width))
    more = F.try_divide("_i", t.lag("_i", change)) - 1
    moved = F.try_divide("close", t.lag("close", change)) - 1
    return flags(own, (more > interest) & (moved > price) if confirm else (more < -interest) & (moved < -price), F.lit(False)).drop("_i")


def liquidation_bounce(df: DataFrame, width: int, times: float, drop: float, after: int) -> DataFrame:
    """Long some bars after a fall beyond `drop` on `times` the mean volume."""
    fell = (F.try_divide("close", t.lag("close")) - 1 < -drop) & (F.try_divide(F.col("volume"), t.mean("volume", width)) > times)
    own = df.withColumn("_f", t.true(fell))
    return flags(own, t.lag("_f", after), F.lit(False)).drop("_f")


# Filters and sizes -------------------------------------------------------------------------------------


def trend_confirmed(entry: str = "entry", width: int = 4800) -> Column:
    """An entry with the price over its long mean (200 days of hours)."""
    return t.true(F.col(entry) & (F.col("close") > t.mean("close", width)))


def volatility_confirmed(df: DataFrame, entry: str = "entry", width: int = 24, base: int = 168) -> DataFrame:
    """df with entries only where the mean relative range is over its own mean."""
    own = df.withColumn("_v", t.mean(F.try_divide(F.col("high") - F.col("low"), F.col("close")), width))
    return own.withColumn(entry, t.true(F.col(entry) & (F.col("_v") > t.mean("_v", base)))).drop("_v")


def coarse_trend(entry: str = "entry", every: int = 4, width: int = 50) -> Column:
    """An entry with the price over the mean of its last `width` closes of bars `every` times as long (as rolled up at each bar)."""
    return t.true(F.col(entry) & (F.col("close") > t.mean("close", every * width)))
