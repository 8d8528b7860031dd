"""Connected components by alternating large-star and small-star steps.

Edges are pairs of comparable keys (here binary digests). A large-star step links
every larger neighbour of a node to the least node around it, a small-star step
every smaller one and the node itself (Kiveris et al., 2014). Both are a grouped
minimum and a join, so no node's neighbourhood is ever gathered anywhere. Rounds end
when the edges no longer change; each round's edges are written to the shared folder.

Defined cases: loops and repeated edges are ignored; edges with a null end are
dropped; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard


# The minima are written before they are joined: both sides of the join are then plain shuffles, of which adaptive
# plans split those that a much linked node makes large.


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), path


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges: u > v."""
    least, path = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), path


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """node, component (its least node) for all nodes that have an edge, and the path of the table it is read from. edges: u, v.
    Rounds go on until the edges settle, which they do: each step moves ends to lesser nodes (in some log^2 n rounds)."""
    spark = edges.sparkSession
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut(now, "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
        if not found[0]:
            break
        large, minima = _large_star(now)
        starred, between = cut(large, "edges")
        discard(spark, minima)
        small, minima = _small_star(starred)
        after, later = cut(small, "edges")
        for gone in (path, between, minima):
            discard(spark, gone)
        now, path = after, later
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct()), path
