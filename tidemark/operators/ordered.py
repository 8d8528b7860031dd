"""Ranks and exact quantiles of large groups: no task sorts a group or holds its values.

Equal values of a group are counted first, which takes care of repeated ones on the map side. The distinct values are then dealt over
ranges of value, cut at approximate percentiles of each group (a sketch of bounded size), and numbered by
a sum inside each range and a scan of the ranges' totals. A tie is one row by then, so none crosses a border.

Groups and values may be NULL: a NULL group is one, NULL values don't count; NaN is greater than all numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import KEY, key_of

#: Ranges that a group's values are dealt over.
RANGES = 64


def value_counts(df: DataFrame, value: Column, by: list[str], ranges: int = RANGES) -> DataFrame:
    """__key, value, n (rows with that value), before (rows with lesser ones) of each group's distinct values."""
    own = df.select(key_of(by).alias(KEY), value.cast("double").alias("value")).filter("value IS NOT NULL")
    counts = own.groupBy(KEY, "value").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy(KEY).agg(F.approx_percentile("value", [k / ranges for k in range(1, ranges)], 16 * ranges).alias("cuts"))
    # a range is the number of cuts below a value: the same for all its copies, and rising with the value
    ranged = counts.join(cuts, KEY).withColumn("range", F.size(F.filter("cuts", lambda x: x < F.col("value")))).drop("cuts")
    lesser = Window.partitionBy(KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(KEY, "range").agg(F.sum("n").alias("_n")).select(KEY, "range", F.coalesce(F.sum("_n").over(lesser), F.lit(0)).alias("_start"))
    within = Window.partitionBy(KEY, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, [KEY, "range"])
    return placed.select(KEY, "value", "n", (F.col("_start") + F.col("_before")).alias("before"))


def average_ranks(df: DataFrame, value: str, by: list[str], name: str, ties: str | None = None, ranges: int = RANGES) -> DataFrame:
    """df with each value's rank in its group (from 1, ties by their average; NULL for NULL); ties: name of a column for the number of rows that share the value."""
    found = value_counts(df, F.col(value), by, ranges).select(F.col(KEY).alias("_k"), F.col("value").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name), *([F.col("n").alias(ties)] if ties else []))
    own = df.withColumn(KEY, key_of(by))
    return own.join(found, (own[KEY] == found["_k"]) & (own[value].cast("double") == found["_v"]), "left").drop(KEY, "_k", "_v")


def quantiles(df: DataFrame, value: Column, by: list[str], qs: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """by and exact, linearly interpolated quantiles {name: q} of each group that has values."""
    counts = value_counts(df, value, by, ranges)
    total = counts.groupBy(KEY).agg(F.sum("n").alias("_total"))
    rows = counts.join(total, KEY)
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("value")))
    made = {}
    for name, q in qs.items():
        place = F.lit(float(q)) * (F.col("_total") - 1)
        made |= {f"_a_{name}": at(F.floor(place)), f"_b_{name}": at(F.ceil(place)), f"_w_{name}": F.first(place - F.floor(place))}
    picked = rows.groupBy(KEY).agg(*(c.alias(k) for k, c in made.items()))
    mixed = {name: F.col(f"_a_{name}") + F.when(F.col(f"_w_{name}") > 0, (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_w_{name}")).otherwise(0.0) for name in qs}
    return picked.select(*(F.col(KEY)[c].alias(c) for c in by), *(c.alias(name) for name, c in mixed.items()))


def with_quantiles(grouped: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """A frame of one row a group with the quantiles of each."""
    own = found.select(F.struct(*by).alias("_k"), *(c for c in found.columns if c not in by))
    return grouped.withColumn(KEY, F.struct(*by)).join(own, F.col(KEY) == F.col("_k"), "left").drop(KEY, "_k")
