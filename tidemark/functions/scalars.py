"""Scalar expressions: time, labels, ratios, sizes. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ms: Column) -> Column:
    """Epoch ms as ISO-8601 text in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Epoch ms of ISO-8601 text."""
    return F.unix_millis(F.try_to_timestamp(text))


def epoch_ms(value: Column) -> Column:
    """Epoch ms of a number in seconds or in ms, told apart by its size."""
    return F.when(F.abs(value) >= 1e12, value).otherwise(value * 1000).cast("long")


def parse_time(text: Column) -> Column:
    """Epoch ms of text: a whole number (s or ms, by its size), a date, or ISO-8601 (UTC unless it has an offset); NULL for others."""
    number = F.when(text.rlike(r"^\s*-?\d+\s*$"), text.try_cast("long"))
    return F.coalesce(epoch_ms(number), F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), parse_iso(text)))


def bar_open(ms: Column, tf_ms: int) -> Column:
    return (F.floor(ms / F.lit(tf_ms)) * tf_ms).cast("long")


def next_bar(ms: Column, tf_ms: int) -> Column:
    return bar_open(ms, tf_ms) + tf_ms


def seconds_to_next(ms: Column, tf_ms: int) -> Column:
    return (next_bar(ms, tf_ms) - ms) / 1000.0


def symbol_pair(text: Column, quote: str = "USDT") -> Column:
    """`btc`, `BTCUSDT` or `btc/usdt` as `BTC/USDT`."""
    clean = F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9]", "")
    return F.concat(F.regexp_replace(clean, f"{quote}$", ""), F.lit(f"/{quote}"))


def direction(ret: Column, flat: float = 0.0005) -> Column:
    """-1, 0 or 1; returns of at most `flat` in size are 0."""
    return F.when(ret.isNull(), None).when(F.abs(ret) <= flat, 0).when(ret > 0, 1).otherwise(-1)


def candle_direction(open_: Column, close: Column) -> Column:
    return F.when(close >= open_, 1).otherwise(-1)


def severity(actual: Column, predicted: Column, bands: tuple[float, ...] = (2.0, 3.0, 5.0), names: tuple[str, ...] = ("none", "moderate", "severe", "extreme")) -> Column:
    """Band of actual / predicted; `names[0]` under the first band or without a positive forecast."""
    r = F.try_divide(actual, predicted)
    out = F.when((predicted <= 0) | r.isNull(), names[0])
    for limit, name in sorted(zip(bands, names[1:]), reverse=True):
        out = out.when(r >= limit, name)
    return out.otherwise(names[0])


def error_kind(actual: Column, predicted: Column) -> Column:
    return F.when(actual > predicted, "under").when(actual < predicted, "over").when(actual == predicted, "exact")


def improvement_pct(base: Column, new: Column) -> Column:
    """By how much new is under base, in percent; NULL for a base of about 0."""
    return F.when(F.abs(base) > 1e-12, F.try_divide(base - new, base) * 100)


def winner(a: Column, b: Column, name_a: str, name_b: str, lower: bool = True) -> Column:
    first, second = (a < b, b < a) if lower else (a > b, b > a)
    return F.when(first, name_a).when(second, name_b).when(a == b, "tie")


def accuracy(error: Column, actual: Column) -> Column:
    """1 - error / actual within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.try_divide(error, actual)))


def rounded_ratio(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(a, b), digits)


def parkinson(high: Column, low: Column) -> Column:
    """One bar's Parkinson variance."""
    return F.when((high > 0) & (low > 0), F.pow(F.log(F.try_divide(high, low)), 2) / (4 * F.log(F.lit(2.0))))


def finite(c: Column) -> Column:
    """Whether a number is neither NULL, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def vol_target_weight(vol: Column, target: float, low: float, high: float, inverse: bool = False) -> Column:
    return clip(F.try_divide(vol, F.lit(target)) if inverse else F.try_divide(F.lit(target), vol), low, high)


def normalised(weight: Column, total: Column) -> Column:
    """A weight as its share of the total weight (a window or group sum); NULL for a total of 0."""
    return F.try_divide(weight, total)


def position_usd(account: Column, vol: Column, target: float = 0.01, most: float = 0.1, least_usd: float = 10.0) -> Column:
    """Size of a position: by target volatility, at most a share of the account, 0 if too small."""
    size = F.least(account * F.try_divide(F.lit(target), vol), account * most)
    return F.when(size < least_usd, 0.0).otherwise(size)


def order_side(direction: Column) -> Column:
    return F.when(direction > 0, "buy").when(direction < 0, "sell")


def edge_signal(expected: Column, cost: float, edge: float = 0.0) -> Column:
    """1 or -1 where the expected return beats costs and a margin, else 0."""
    return F.when(expected > cost + edge, 1).when(expected < -(cost + edge), -1).otherwise(0)


def banded_label(value: Column, limits: list[float], names: list[str]) -> Column:
    """names[i] for the first limit above value, the last name beyond all; NULL stays NULL."""
    out = F.when(value.isNull(), None)
    for limit, name in zip(limits, names):
        out = out.when(value < limit, name)
    return out.otherwise(names[-1])


def canonical_id(*columns: Column) -> Column:
    """A stable id: MD5 of the columns' text in the given order."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that doesn't hold (NULL counts as failing); NULL if all hold."""
    out = None
    for name, holds in checks:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def amount_proxy(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    return volume * (open_ + high + low + close) / 4


def short_number(value: Column) -> Column:
    """1.2K, 3.4M and so on."""
    return F.when(F.abs(value) >= 1e6, F.format_string("%.1fM", value / 1e6)).when(F.abs(value) >= 1e3, F.format_string("%.1fK", value / 1e3)).otherwise(F.format_string("%.2f", value))


def money(value: Column, digits: int = 2) -> Column:
    """$1,234.50, with the sign in front."""
    return F.when(value.isNotNull(), F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(value), digits)))


def percent(share: Column, digits: int = 2) -> Column:
    """A share as 12.34%, with a + for gains."""
    return F.when(share.isNotNull(), F.concat(F.when(share > 0, "+").otherwise(""), F.format_string(f"%.{digits}f%%", F.round(share * 100, digits))))


def regex_field(text: Column, pattern: str) -> Column:
    """The first group of a pattern, NULL where it doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
