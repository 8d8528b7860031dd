"""Whether two ordered tables are the same, and where they first differ, by hash trees.

A leaf of the tree is a span of time of one series: the SHA-256 of its rows' digests in the order of their key, so that
swapped rows, moved values and swapped parts of hashes all show. FAN leaves make a node above, and so on up to one root a series. Two trees
are compared from the roots down, and only the children of the first node that differs are looked at; of the tables
themselves the rows of that one leaf are read. A tree is a small table: it can be stored, and compared with later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import row_digest
from tidemark.schema import DAY_MS

#: Nodes under one of the next level, levels above the leaves, and what a leaf covers.
FAN, LEVELS, SPAN_MS = 64, 3, 7 * DAY_MS
TREE = "asset string, level int, node long, n long, digest string"
MISMATCH = "asset string, ts long, field string, left_value string, right_value string"


def _joined(order: str) -> Column:
    """The digest of a group's digests, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256)


def tree(df: DataFrame, columns: list[str], span_ms: int = SPAN_MS) -> DataFrame:
    """asset, level (0: leaves), node, n (rows) and digest: a leaf holds the rows of one span of time, so what is gathered is bounded by the rows of a span."""
    rows = df.select("asset", "ts", F.floor(F.col("ts") / F.lit(span_ms)).cast("long").alias("node"), row_digest(["asset", "ts", *columns]).alias("digest"))
    level = rows.groupBy("asset", "node").agg(F.count(F.lit(1)).alias("n"), _joined("ts").alias("digest"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, LEVELS + 1):
        up = F.floor(F.col("node") / F.lit(FAN)).cast("long") if k < LEVELS else F.lit(0).cast("long")
        level = level.groupBy("asset", up.alias("_up")).agg(F.sum("n").alias("n"), _joined("node").alias("digest")).withColumnRenamed("_up", "node")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("asset", "level", "node", "n", "digest")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """asset, level, node of the nodes that two trees don't share."""
    key = ["asset", "level", "node"]
    left, right = (x.select(F.struct(*key).alias("key"), F.struct("n", "digest").alias(name)) for x, name in ((a, "left"), (b, "right")))
    return left.join(right, "key", "full").filter(~F.col("left").eqNullSafe(F.col("right"))).select("key.*")


def first_leaf(a: DataFrame, b: DataFrame) -> tuple[str | None, int] | None:
    """The series and span of the first leaf in which two trees differ, None if they are equal; nodes below equal ones aren't compared."""
    where, asset = F.lit(True), None
    for level in range(LEVELS, -1, -1):
        found = differing(*(x.filter((F.col("level") == level) & where) for x in (a, b))).orderBy(F.col("asset").asc_nulls_first(), "node").first()
        if found is None:
            return None
        asset, node = found["asset"], found["node"]
        below = F.floor(F.col("node") / F.lit(FAN)) == node if level < LEVELS else F.lit(True)
        where = F.col("asset").eqNullSafe(F.lit(asset)) & below
    return asset, node


def first_mismatch(a: DataFrame, b: DataFrame, columns: list[str], span_ms: int = SPAN_MS, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: the key and column at which two tables of bars first differ, in the order of asset, ts and columns, with both values as text; no row if they
    are equal. A row that one side lacks has the field `row`. trees: stored ones of both tables."""
    spark = a.sparkSession
    found = first_leaf(*(trees or (tree(a, columns, span_ms), tree(b, columns, span_ms))))
    if found is None:
        return spark.createDataFrame([], MISMATCH)
    asset, node = found
    hold = F.col("asset").eqNullSafe(F.lit(asset)) & (F.col("ts") >= node * span_ms) & (F.col("ts") < (node + 1) * span_ms)
    sides = []
    for df, name in ((a, "left"), (b, "right")):
        again = F.row_number().over(Window.partitionBy("ts").orderBy(*columns))  # rows of one key, in the order of their values
        sides.append(df.filter(hold).select("ts", again.alias("again"), F.array(*(F.col(c).cast("string") for c in columns)).alias(name)))
    both = sides[0].join(sides[1], ["ts", "again"], "full")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(columns))), lambda i: F.struct(i.alias("i"), F.get(F.array(F.lit("row"), *(F.lit(c) for c in columns)), i).alias("field"), F.get("left", i - 1).alias("l"), F.get("right", i - 1).alias("r"))))
    lone = F.col("left").isNull() | F.col("right").isNull()
    rows = both.withColumn("_lone", lone).select("ts", "again", "_lone", pairs.alias("p")).filter(F.when(F.col("_lone"), F.col("p.i") == 0).otherwise((F.col("p.i") > 0) & ~F.col("p.l").eqNullSafe(F.col("p.r"))))
    return rows.orderBy("ts", "again", "p.i").limit(1).select(F.lit(asset).cast("string").alias("asset"), "ts", "p.field", F.col("p.l").alias("left_value"), F.col("p.r").alias("right_value"))
