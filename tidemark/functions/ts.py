"""Window frames of time series.

Every frame is partitioned by explicit keys, so series are spread over tasks. Rolling
functions are NULL until the frame holds `least` non-null values (all of its
width, if not given), unlike bare Spark frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BY, TS = ("asset",), "ts"


def order(by: tuple[str, ...] = BY, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def frame(first: int, last: int = 0, by: tuple[str, ...] = BY, ts: str = TS) -> WindowSpec:
    """Rows from first to last, relative to the current one."""
    return order(by, ts).rowsBetween(first, last)


def past(by: tuple[str, ...] = BY, ts: str = TS, last: int = 0) -> WindowSpec:
    """All rows up to `last`."""
    return order(by, ts).rowsBetween(Window.unboundedPreceding, last)


def lag(c: Column | str, n: int = 1, by: tuple[str, ...] = BY, ts: str = TS) -> Column:
    return F.lag(c, n).over(order(by, ts))


def lead(c: Column | str, n: int = 1, by: tuple[str, ...] = BY, ts: str = TS) -> Column:
    return F.lead(c, n).over(order(by, ts))


def rolling(fn: Callable[[Column], Column], c: Column | str, width: int, shift: int = 0, least: int | None = None, by: tuple[str, ...] = BY, ts: str = TS) -> Column:
    """fn over `width` rows that end `shift` rows before the current one."""
    c = F.col(c) if isinstance(c, str) else c
    w = frame(-width - shift + 1, -shift, by, ts)
    return F.when(F.count(c).over(w) >= (width if least is None else least), fn(c).over(w))


def mean(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    return rolling(F.avg, c, width, shift, least, **keys)


def std(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    """Sample deviation (n - 1)."""
    return rolling(F.stddev_samp, c, width, shift, least, **keys)


def std_pop(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    return rolling(F.stddev_pop, c, width, shift, least, **keys)


def low(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    return rolling(F.min, c, width, shift, least, **keys)


def high(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    return rolling(F.max, c, width, shift, least, **keys)


def total(c, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    return rolling(F.sum, c, width, shift, least, **keys)


def quantile(c, q: float, width: int, shift: int = 0, least: int | None = None, **keys) -> Column:
    """Exact, linearly interpolated."""
    return rolling(lambda x: F.percentile(x, q), c, width, shift, least, **keys)


def ewm(c: Column | str, span: int, context: int, shift: int = 0, by: tuple[str, ...] = BY, ts: str = TS) -> Column:
    """Exponentially weighted mean (alpha = 2 / (span + 1)) seeded by the first of the last `context` rows."""
    alpha = 2.0 / (span + 1)
    values = F.collect_list(c).over(frame(-context - shift + 1, -shift, by, ts))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, context), F.element_at(values, 1), lambda a, x: a + F.lit(alpha) * (x - a)))


def true(c: Column) -> Column:
    """A condition with NULL as false."""
    return F.coalesce(c, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def average_rank(c: Column | str, by: tuple[str, ...]) -> Column:
    """Rank from 1, ties by their average."""
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0
