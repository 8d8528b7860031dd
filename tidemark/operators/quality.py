"""Audits of bars: invariants, repeats, gaps, order, alignment, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import ts as t
from tidemark.schema import DAY_MS, HOUR_MS

PRICES = ("open", "high", "low", "close")


def issues() -> Column:
    """Names of the invariants that a bar breaks."""
    o, h, lo, c, v = (F.col(x) for x in (*PRICES, "volume"))
    rules = [
        *((f"{x}_not_finite", F.col(x).isNull() | F.isnan(x) | (F.abs(F.col(x)) == float("inf"))) for x in (*PRICES, "volume")),
        *((f"{x}_not_positive", F.col(x) <= 0) for x in PRICES),
        ("volume_negative", v < 0), ("high_under_low", h < lo), ("high_under_open", h < o), ("high_under_close", h < c), ("low_over_open", lo > o), ("low_over_close", lo > c),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def invalid(bars: DataFrame) -> DataFrame:
    """Bars with issues."""
    return bars.withColumn("issues", issues()).filter(F.size("issues") > 0)


def valid(bars: DataFrame) -> DataFrame:
    return bars.filter(F.size(issues()) == 0)


def repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, and how many rows are repeats."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("repeats", F.col("n") - 1)


def gaps(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """asset, ts (after the gap), previous_ts, missing, aligned: spacings other than the width. Aligned gaps miss
    spacing / width - 1 bars; irregular ones are rounded half to even; spacings under the width overlap."""
    d = F.col("ts") - F.col("previous_ts")
    rows = bars.select("asset", "ts", t.lag("ts").alias("previous_ts")).filter(F.col("previous_ts").isNotNull() & (d != width_ms))
    aligned = d % width_ms == 0
    missing = F.when(aligned, F.floor(d / F.lit(width_ms)) - 1).otherwise(F.bround(d / F.lit(float(width_ms))).cast("long") - 1)
    return rows.withColumn("aligned", aligned).withColumn("missing", missing.cast("long")).withColumn("overlap", d < width_ms)


def gap_ranges(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """asset, first and last missing time, bars missing."""
    nxt = t.lead("ts")
    rows = bars.select("asset", "ts", nxt.alias("n")).filter(F.col("n") - F.col("ts") > width_ms)
    count = F.floor((F.col("n") - F.col("ts")) / F.lit(width_ms)) - 1
    return rows.select("asset", (F.col("ts") + width_ms).alias("first_missing"), (F.col("n") - width_ms).alias("last_missing"), count.cast("long").alias("missing")).filter("missing > 0")


def missing_times(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Grid times between an asset's first and last bar at which it has none."""
    span = bars.groupBy("asset").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("asset", F.explode(F.sequence("a", "b", F.lit(width_ms))).alias("ts"))
    return grid.join(bars.select("asset", "ts"), ["asset", "ts"], "left_anti")


def out_of_order(rows: DataFrame, arrival: str = "seq") -> DataFrame:
    """Rows that arrived after a row of a later time."""
    before = F.max("ts").over(Window.partitionBy("asset").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("latest_before", before).filter("ts < latest_before")


def misaligned_runs(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """Runs of neighbouring off-grid rows: bounds, length, offsets."""
    rows = bars.withColumn("offset", F.col("ts") % width_ms).withColumn("bad", (F.col("offset") != 0).cast("int"))
    numbered = rows.withColumn("run", F.row_number().over(t.order()) - F.row_number().over(Window.partitionBy("asset", "bad").orderBy("ts"))).filter("bad = 1")
    return numbered.groupBy("asset", "run").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("offset")).alias("offsets")).drop("run")


def interval_histogram(bars: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent spacings of each asset."""
    counts = bars.select("asset", (F.col("ts") - t.lag("ts")).alias("interval_ms")).dropna().groupBy("asset", "interval_ms").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "interval_ms"))
    return counts.withColumn("place", at).filter(F.col("place") <= top)


def utc_text_matches(ms: Column, text: Column) -> Column:
    """Whether an ISO text with an explicit UTC offset states the same time."""
    return F.coalesce(text.rlike(r"(Z|[+-]00:?00)$") & (F.unix_millis(F.try_to_timestamp(text)) == ms), F.lit(False))


def daily_at_midnight(bars: DataFrame) -> DataFrame:
    """Daily bars that don't open at midnight UTC."""
    return bars.filter(F.col("ts") % DAY_MS != 0)


def validate_context(bars: DataFrame, length: int, width_ms: int = HOUR_MS) -> DataFrame:
    """bars with skip_reason: why the `length` bars before each can't be a model's context (NULL: they can)."""
    w = t.frame(-length, -1)
    ok = F.min((F.size(issues()) == 0).cast("int")).over(w)
    return bars.withColumn("skip_reason", s.first_failing([("context_short", F.count(F.lit(1)).over(w) >= length), ("context_gap", (F.max("ts").over(w) - F.min("ts").over(w)) == (length - 1) * width_ms), ("context_invalid", ok == 1), ("target_gap", F.col("ts") - t.lag("ts") == width_ms), ("invalid_target", F.size(issues()) == 0)]))


def leakage(inputs: DataFrame, targets: DataFrame, at: int) -> DataFrame:
    """One row: whether inputs end by `at`, targets begin after it, and no time is in both."""
    a = inputs.agg(F.max("ts").alias("last_input"))
    b = targets.agg(F.min("ts").alias("first_target"))
    both = inputs.select("ts").intersect(targets.select("ts")).agg(F.count(F.lit(1)).alias("shared"))
    return a.join(b).join(both).withColumn("ok", (F.col("last_input") <= at) & (F.col("first_target") > at) & (F.col("shared") == 0))  # one row each


def availability(frames: dict[str, tuple[DataFrame, int]], at: int, base_ms: int = HOUR_MS) -> DataFrame:
    """For each timeframe and asset: the newest bar that has closed by the end of the base bar at `at`."""
    parts = [bars.filter(F.col("ts") + width <= at + base_ms).groupBy("asset").agg(F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n")).withColumn("timeframe", F.lit(name)) for name, (bars, width) in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aligned_history(frames: dict[str, tuple[DataFrame, int, int]], at: int, base_ms: int = HOUR_MS) -> DataFrame:
    """The last k closed bars of each timeframe by the end of the base bar at `at`; frames: name to (bars, width, k)."""
    out = None
    for name, (bars, width, k) in frames.items():
        place = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
        part = bars.filter(F.col("ts") + width <= at + base_ms).withColumn("_r", place).filter(F.col("_r") <= k).drop("_r").withColumn("timeframe", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def audit(bars: DataFrame, width_ms: int = HOUR_MS) -> DataFrame:
    """One row for each asset: rows, span, repeats, gaps, alignment, invalid rows, and an overall flag."""
    d = F.col("ts") - F.lag("ts").over(t.order())
    rows = bars.withColumn("_d", d).withColumn("_i", F.size(issues()))
    gap = F.col("_d") > width_ms
    out = rows.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("_d") == 0).alias("repeats"), F.count_if(gap).alias("gaps"),
        F.coalesce(F.sum(F.when(gap, F.floor(F.col("_d") / F.lit(width_ms)) - 1)), F.lit(0)).cast("long").alias("missing"),
        F.count_if(F.col("ts") % width_ms != 0).alias("misaligned"), F.count_if(F.col("_i") > 0).alias("invalid"),
    )
    return out.withColumn("overall_valid", (F.col("repeats") == 0) & (F.col("gaps") == 0) & (F.col("misaligned") == 0) & (F.col("invalid") == 0))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's canonical text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def table_digest(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows and an order-free digest of each group: the sum of 31-bit parts of the rows' hashes, which adds up in any order and over any partition."""
    part = F.conv(F.substring(row_digest(columns), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def parity(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of one table that the other lacks or holds differently, with the side they are on."""
    common = a.columns
    left = a.exceptAll(b.select(common)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(common).exceptAll(a).withColumn("side", F.lit("right")))
