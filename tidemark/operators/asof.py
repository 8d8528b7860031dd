"""As-of joins and interval aggregates without loops or cross products.

Rows of both sides are tagged, united and dealt over spans of time of each key. Inside a span the newest right row
is a window function; at a span's start it is that of the nearest span before that has any, which is a scan of
one row for each span. So a key that holds most rows is many tasks. Linear, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import blocks
from tidemark.functions.scalars import finite

BY = ["asset"]


def _united(left: DataFrame, right: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    # the left row travels as a struct; right rows stand before left ones at equal times
    a = left.select(*by, F.col("ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    b = right.select(*by, F.col("ts"), F.lit(0).alias("_side"), F.struct(F.col("ts").alias("_ts"), *values).alias("_right"))
    return a.unionByName(b, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, values: list[str], by: list[str] = BY, direction: str = "backward", tolerance_ms: int | None = None, matched: str | None = None, span_ms: int = blocks.SPAN_MS) -> DataFrame:
    """left with values of the right row that is the newest at or before (backward), the oldest at or after (forward),
    or the nearest to its time (of two equally near ones, the earlier). matched: name of a column for that row's time.
    Of right rows of equal time, the one of the greatest values counts backward, the least forward."""
    rows = blocks.spanned(_united(left, right, by, values), by, span_ms=span_ms)
    edges = rows.groupBy(blocks.KEY, blocks.SPAN).agg(F.max("_right").alias("z"), F.min("_right").alias("a"))
    back = blocks.carried(edges, {"_carried_b": F.last("z", ignorenulls=True)})
    ahead = blocks.carried(edges, {"_carried_a": F.last("a", ignorenulls=True)}, backwards=True)
    own = [blocks.KEY, blocks.SPAN]
    if direction != "forward":
        rows = rows.join(back, own)
    if direction != "backward":
        rows = rows.join(ahead, own)
    inside = Window.partitionBy(*own)
    before = lambda: F.coalesce(F.last("_right", ignorenulls=True).over(inside.orderBy("ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried_b"))
    # from the end on: Spark recomputes a frame that ends at the partition's end for each row, in quadratic time
    after = lambda: F.coalesce(F.last("_right", ignorenulls=True).over(inside.orderBy(F.desc("ts"), "_side", F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried_a"))
    if direction == "backward":
        found = rows.withColumn("_m", before())
    elif direction == "forward":
        found = rows.withColumn("_m", after())
    elif direction == "nearest":
        both = rows.withColumn("_b", before()).withColumn("_a", after())
        nearer = F.col("_a._ts") - F.col("ts") < F.col("ts") - F.col("_b._ts")
        found = both.withColumn("_m", F.when(F.col("_b").isNull() | nearer, F.col("_a")).otherwise(F.col("_b")))
    else:
        raise ValueError(f"no direction {direction}")
    m = F.col("_m")
    if tolerance_ms is not None:
        m = F.when(F.abs(F.col("ts") - F.col("_m._ts")) <= tolerance_ms, m)
    found = found.filter("_side = 1").withColumn("_m", m)
    return found.select("_left.*", *(F.col("_m")[v].alias(v) for v in values), *([F.col("_m._ts").alias(matched)] if matched else []))


def asof_lagged(left: DataFrame, right: DataFrame, value: str, by: list[str] = BY, span_ms: int = blocks.SPAN_MS, rows: int | None = None) -> DataFrame:
    """As-of backward, then one left row later: what was known before the row's bar opened."""
    lagged = F.lag(value).over(Window.partitionBy(*by).orderBy("ts"))
    return blocks.bounded(asof(left, right, [value], by, span_ms=span_ms), lambda x: x.withColumn(value, lagged), 1, by=tuple(by), rows=rows, span_ms=span_ms)


def interval_mean(left: DataFrame, right: DataFrame, value: str, window_ms: int, stale_ms: int | None = None, by: list[str] = BY, name: str | None = None, span_ms: int = blocks.SPAN_MS) -> DataFrame:
    """left with the mean, mean size and count of finite right values in (ts - window_ms, ts]; NULL if the newest is older than stale_ms.

    Running sums at both ends of each interval are subtracted, so the cost doesn't grow with what an interval holds."""
    name = name or f"{value}_mean"
    v = F.col("_right")[value]
    v = F.when(finite(v), v)  # one NaN would stay in all running sums after it
    begins = left.select(*by, "ts").distinct().select(*by, (F.col("ts") - window_ms).alias("ts"), F.lit(2).alias("_side"), F.col("ts").alias("_of"))
    rows = _united(left, right, by, [value]).unionByName(begins, allowMissingColumns=True)
    run = blocks.running(rows, {"_s": ("sum", v), "_a": ("sum", F.abs(v)), "_n": ("count", v), "_newest": ("last", F.col("_right._ts"))}, by, order=["ts", "_side"], span_ms=span_ms)
    run = run.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_s", "_a")})
    starts = run.filter("_side = 2").select(*by, F.col("_of").alias("ts"), *(F.col(c).alias(f"{c}0") for c in ("_s", "_a", "_n")))
    both = run.filter("_side = 1").join(starts, [*by, "ts"])
    n = F.col("_n") - F.col("_n0")
    fresh = F.lit(True) if stale_ms is None else F.col("ts") - F.col("_newest") <= stale_ms
    mean = lambda c: F.when(fresh & (n > 0), F.try_divide(F.col(c) - F.col(f"{c}0"), n))
    return both.select("_left.*", mean("_s").alias(name), mean("_a").alias(f"abs_{name}"), n.alias(f"{name}_n"))


def shifted(left: DataFrame, right: DataFrame, values: list[str], step_ms: int, by: list[str] | None = None, prefix: str = "other_") -> DataFrame:
    """left with right's values at exactly ts - step_ms (an equi-join), and whether there are any."""
    own = right.select(*(by or []), (F.col("ts") + step_ms).alias("ts"), *(F.col(v).alias(f"{prefix}{v}") for v in values), F.lit(True).alias("_hit"))
    return left.join(own, [*(by or []), "ts"], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def coalesced(live: DataFrame, history: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Live values over historical ones, on all keys of either."""
    a, b = live.select(*key, F.col(value).alias("_l")), history.select(*key, F.col(value).alias("_h"))
    return a.join(b, key, "full").select(*key, F.coalesce("_l", "_h").alias(value))
