"""Shards by jump consistent hashing.

A row's key and the number of shards alone decide its shard (Lamping and Veach,
2014): no ring table is kept, shards hold near equal counts, and with one shard
more only the rows that move into it move at all.

Slots number the rows of a shard without gaps. Rows of a shard are dealt into
ranges by a second hash (of all that they are ordered by, so that rows of one key part
where anything else differs), numbered within a range, and shifted by the sizes of the
ranges before: one shuffle, and no task ever holds a whole shard. Rows alike in everything share a
range, which is sorted with spills.

Defined cases: a null key is the key 0; repeated keys share a shard and
get slots of their own; null text is empty; an empty table gives no rows;
columns named like those added are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

_STEP = np.uint64(2862933555777941757)

#: Rows of one range of slots, about; bounds what one task sorts for a key.
RANGE_ROWS = 20_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    at, to = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = to[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Column of shards for a stable key of type long."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64, na_value=0).view(np.uint64), shards))

    return of(key)


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with size, shard and grown_shard (the shard if there were one more)."""
    stable = F.coalesce(F.col(key).cast("long"), F.lit(0))
    return docs.withColumns({"size": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1, "shard": shard_of(stable, shards), "grown_shard": shard_of(stable, shards + 1)})


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with slot: 0, 1, 2 ... within each shard."""
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    part, at, base, n = fresh(rows, "range", "at", "base", "n")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", part).agg(F.count(F.lit(1)).alias(n)).withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = Window.partitionBy("shard", part).orderBy(*order)
    numbered = rows.withColumn(at, F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", part]).withColumn("slot", (F.col(base) + F.col(at)).cast("long")).drop(part, base, at)
