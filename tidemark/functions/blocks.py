"""Long series in blocks, so that no task has to hold a whole series.

A window keyed by series alone puts each series into one task. Here a series is dealt over blocks:

* `placed`: each row's place in its series, from row numbers within spans of time and the counts of the spans before.
* `bounded`: functions of a frame of a fixed number of rows, on blocks of equally many rows; each block also gets
  the rows that its frames reach into (its halo), which are dropped again.
* `running`: totals, extremes and newest values from the start of a series on, as a scan inside each span and a scan
  of the spans' totals.
* `quantiles`: order statistics of a moving window by a wavelet matrix of each block, in logarithmic time whatever the width.
* `ema`: exponential means over a whole past, as a scan of affine maps: each span is one map, and the maps of a series are composed.

What is scanned over a whole series is one row for each span. A scan reads its input twice (rows and totals), so steps one after another
multiply what they stand on: write a costly or shared input to a table first. Rows of a series are told apart by their time;
of rows of equal time, any order is right. Series with NULL in their key are series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ts import BY, TS

#: Time that one span covers, and rows of a block.
SPAN_MS, ROWS = 64 * 86_400_000, 1 << 16
AT, SPAN, KEY, BLOCK = "__at", "__span", "__key", "__block"


def key_of(by: tuple[str, ...] | list[str]) -> Column:
    """The key of a series as one column, which is never NULL."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("none"))


def spanned(df: DataFrame, by=BY, ts: str = TS, span_ms: int = SPAN_MS) -> DataFrame:
    return df.withColumns({KEY: key_of(by), SPAN: F.floor(F.col(ts) / F.lit(span_ms)).cast("long")})


def carried(totals: DataFrame, columns: dict[str, Column], backwards: bool = False) -> DataFrame:
    """Scans of span totals (a row for each key and span): columns are aggregates of all spans before (after, if backwards)."""
    w = Window.partitionBy(KEY).orderBy(F.desc(SPAN) if backwards else F.col(SPAN)).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(KEY, SPAN, *(c.over(w).alias(name) for name, c in columns.items()))


def placed(df: DataFrame, by=BY, ts: str = TS, span_ms: int = SPAN_MS) -> DataFrame:
    """df with __at, each row's place in its series (from 0); a frame that has it stays as it is."""
    if AT in df.columns:
        return df
    own = spanned(df, by, ts, span_ms)
    starts = carried(own.groupBy(KEY, SPAN).agg(F.count(F.lit(1)).alias("n")), {"__start": F.sum("n")})
    own = own.withColumn(AT, F.row_number().over(Window.partitionBy(KEY, SPAN).orderBy(ts)) - 1)
    own = own.join(starts, [KEY, SPAN]).withColumn(AT, (F.col(AT) + F.coalesce("__start", F.lit(0))).cast("long"))
    return own.select(*df.columns, AT)


def copies(df: DataFrame, before: int, after: int, rows: int) -> DataFrame:
    """A placed frame with __block: every row in its own block and in those whose frames reach it."""
    first, last = F.greatest(F.col(AT) - after, F.lit(0)), F.col(AT) + before
    return df.withColumn(BLOCK, F.explode(F.sequence(F.floor(first / rows), F.floor(last / rows))))


def bounded(df: DataFrame, fn: Callable[[DataFrame], DataFrame], before: int, after: int = 0, by=BY, ts: str = TS, rows: int | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """fn(df), block by block. fn adds columns to rows, by windows keyed by `by` that reach at most `before` rows back and `after` rows ahead; it
    must take the first key column for a mere key (it holds the block, too)."""
    rows = rows or max(ROWS, 4 * (before + after))
    had, key = AT in df.columns, by[0]
    own = copies(placed(df, by, ts, span_ms), before, after, rows)
    out = fn(own.withColumn(key, F.struct(F.col(key).alias("key"), F.col(BLOCK).alias("block"))).drop(BLOCK))
    out = out.filter(F.floor(F.col(AT) / rows) == F.col(key)["block"]).withColumn(key, F.col(key)["key"])
    return out if had else out.drop(AT)


_SCANS: dict[str, tuple[Callable, Callable, Callable]] = {  # aggregate, scan of span totals, both together
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda c: F.first(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def running(df: DataFrame, columns: dict[str, tuple[str, Column]], by=BY, ts: str = TS, order: list[str] | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """df with columns {name: (kind, value)}: sum, count, max, min, last or first (not NULL) of a series' values up to each row.
    order: what a series is ordered by, the time first."""
    own = spanned(df, by, ts, span_ms)
    order = order or [ts]
    own = own.withColumns({f"__v_{name}": value for name, (_, value) in columns.items()})
    at = F.struct(*order)

    def total(name: str, kind: str) -> Column:
        c = F.col(f"__v_{name}")
        if kind in ("last", "first"):  # by their place, as rows of a group have no order
            return (F.max_by if kind == "last" else F.min_by)(c, F.when(c.isNotNull(), at))
        return _SCANS[kind][0](c)

    totals = own.groupBy(KEY, SPAN).agg(*(total(name, kind).alias(f"__t_{name}") for name, (kind, _) in columns.items()))
    before = carried(totals, {f"__b_{name}": _SCANS[kind][1](F.col(f"__t_{name}")) for name, (kind, _) in columns.items()})
    w = Window.partitionBy(KEY, SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"__i_{name}": _SCANS[kind][0](F.col(f"__v_{name}")).over(w) for name, (kind, _) in columns.items()})
    made = {name: _SCANS[kind][2](F.col(f"__b_{name}"), F.col(f"__i_{name}")) for name, (kind, _) in columns.items()}
    kept = [c for c in df.columns if c not in made]
    return own.join(before, [KEY, SPAN]).withColumns(made).select(*kept, *made)


# Order statistics of moving windows ----------------------------------------------------------------------


def kth(codes: np.ndarray, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of codes[first:end], for all queries at once, by a wavelet matrix: one pass for each bit of a code."""
    found = np.zeros(len(k), np.int64)
    for bit in range(int(codes.max(initial=0)).bit_length() - 1, -1, -1):
        one = (codes >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b = zeros[first], zeros[end]
        up = k >= b - a
        found |= up.astype(np.int64) << bit
        k = np.where(up, k - (b - a), k)
        first, end = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + end - b, b)
        codes = np.concatenate([codes[~one], codes[one]])
    return found


def moving_quantiles(values: np.ndarray, known: np.ndarray, qs: list[float], width: int, shift: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, whether there is one) of each quantile of the known values in the `width` rows that end `shift` rows before each."""
    n = len(values)
    distinct, codes = np.unique(values[known], return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(known)])
    end = np.clip(np.arange(n) - shift + 1, 0, n)
    first = np.clip(end - width, 0, n)
    first, end = upto[first], upto[end]
    ok = end - first >= max(least, 1)
    out = []
    for q in qs:
        place = q * (end - first - 1)[ok]
        low = np.floor(place)
        a, b = (distinct[kth(codes, first[ok], end[ok], x.astype(np.int64))] if ok.any() else np.zeros(0) for x in (low, np.ceil(place)))
        full = np.zeros(n)
        full[ok] = a + (b - a) * (place - low)
        out.append((full, ok))
    return out


def quantiles(df: DataFrame, c: str, qs: dict[str, float], width: int, shift: int = 0, least: int | None = None, by=BY, ts: str = TS, rows: int | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """df with exact, linearly interpolated quantiles {name: q} of c over `width` rows that end `shift` rows before each; NULL under `least` values."""
    before, least = width + shift, width if least is None else least
    rows = rows or max(ROWS, 4 * before)
    had = AT in df.columns
    own = copies(placed(df, by, ts, span_ms), before, 0, rows).withColumns({KEY: key_of(by), "__c": F.col(c).cast("double")})

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table[AT]))
        values = table["__c"].combine_chunks() if table["__c"].num_chunks != 1 else table["__c"].chunk(0)
        known = ~np.asarray(values.is_null())
        for name, (found, ok) in zip(qs, moving_quantiles(values.fill_null(0.0).to_numpy(zero_copy_only=False), known, list(qs.values()), width, shift, least)):
            table = table.append_column(name, pa.array(found, mask=~ok))
        mine = np.asarray(table[AT]) // rows == np.asarray(table[BLOCK])
        return table.filter(pa.array(mine)).drop_columns([BLOCK, KEY, "__c"])

    own = own.drop(*qs)
    fields = [f for f in own.schema.fields if f.name not in (BLOCK, KEY, "__c")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{name}` double" for name in qs)])
    out = own.groupBy(KEY, BLOCK).applyInArrow(run, schema)
    return out if had else out.drop(AT)


# Exponential means -----------------------------------------------------------------------------------------


def _folded(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    """y[i] = y[i-1] + alpha (x[i] - y[i-1]), from y[-1] = start, in steps of 64 rows at once."""
    out, keep = np.empty(len(x)), 1.0 - alpha
    powers = keep ** np.arange(65)
    lower = np.tril(alpha * keep ** np.maximum(np.arange(64)[:, None] - np.arange(64)[None, :], 0))
    for i in range(0, len(x), 64):
        part = x[i : i + 64]
        out[i : i + 64] = powers[1 : len(part) + 1] * start + lower[: len(part), : len(part)] @ part
        start = out[i + len(part) - 1]
    return out


def ema(df: DataFrame, c: str, span: int, name: str, by=BY, ts: str = TS, span_ms: int = SPAN_MS) -> DataFrame:
    """df with the exponential mean (alpha = 2 / (span + 1)) of c over a series' whole past, seeded by its first value; NULL and NaN don't count."""
    alpha = 2.0 / (span + 1)
    own = spanned(df.drop(name), by, ts, span_ms).withColumn("__c", F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
    first = own.groupBy(KEY).agg(F.min_by("__c", F.when(F.col("__c").isNotNull(), F.col(ts))).alias("__seed"))

    def last(table: pa.Table) -> pa.Table:  # the span as a map: y -> keep^n y + end
        x = np.asarray(table.take(pc.sort_indices(table["__ts"]))["__c"])
        return table.slice(0, 1).select([KEY, SPAN]).append_column("__n", pa.array([len(x)], pa.int64())).append_column("__end", pa.array([float(_folded(x, alpha, 0.0)[-1])]))

    kind = own.schema[KEY].dataType.simpleString()
    maps = own.filter("__c IS NOT NULL").select(KEY, SPAN, F.col(ts).alias("__ts"), "__c").groupBy(KEY, SPAN).applyInArrow(last, f"`{KEY}` {kind}, `{SPAN}` long, __n long, __end double")

    def compose(table: pa.Table) -> pa.Table:  # a row for each span of a series
        table = table.take(pc.sort_indices(table[SPAN]))
        now, out = table["__seed"][0].as_py(), []
        for n, end in zip(table["__n"].to_pylist(), table["__end"].to_pylist()):
            out.append(now)
            if n and now is not None:
                now = (1.0 - alpha) ** n * now + end
        return table.select([KEY, SPAN]).append_column("__from", pa.array(out, pa.float64()))

    spans = own.select(KEY, SPAN).distinct().join(maps, [KEY, SPAN], "left").join(first, KEY)
    starts = spans.groupBy(KEY).applyInArrow(compose, f"`{KEY}` {kind}, `{SPAN}` long, __from double")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table[ts]))
        x = table["__c"].combine_chunks()
        known, start = ~np.asarray(x.is_null()), table["__from"][0].as_py()
        if start is None or not len(x):
            found = pa.nulls(table.num_rows, pa.float64())
        else:
            values = np.concatenate([[start], _folded(np.asarray(x.drop_null(), dtype=float), alpha, start)])[np.cumsum(known)]
            # rows of the first span before its first value have none
            none = (np.cumsum(known) == 0) & bool(table["__first"][0].as_py())
            found = pa.array(values, mask=none)
        return table.append_column(name, found).drop_columns([KEY, SPAN, "__c", "__from", "__first"])

    least = first.join(own.filter("__c IS NOT NULL").groupBy(KEY).agg(F.min(SPAN).alias("__least")), KEY, "left")
    joined = own.join(starts, [KEY, SPAN]).join(least.select(KEY, "__least"), KEY).withColumn("__first", F.coalesce(F.col(SPAN) <= F.col("__least"), F.lit(True))).drop("__least")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(name).schema.fields), f"`{name}` double"])
    return joined.groupBy(KEY, SPAN).applyInArrow(run, schema)
