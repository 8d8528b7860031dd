"""Lineage of hypotheses: parents, ancestors and staged rejections.

All ancestors come by pointer doubling: each round joins the pairs (node, ancestor at distance up to d) with themselves, so that
a line of any length takes a logarithmic number of rounds. Where each node has one parent and only its line's end is asked for
(`ends`, `generations`), a node is one row in each round. Each round is written to a shared folder. Nodes that their own
ancestry leads back to are on a cycle; they and what descends from them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stage names of rejections that this module itself makes, in their order.
REPEATED, ORPHANED, CYCLIC = "repeated", "no parent", "cycle"


def ancestors(edges: DataFrame, path: str, most_rounds: int = 40) -> DataFrame:
    """node, ancestor, distance (the shortest) for each node's ancestors. edges: node, parent (several of a node are several parents); path: a folder that executors share."""
    spark = edges.sparkSession
    schema = "node string, ancestor string, distance long"
    links = edges.filter(F.col("parent").isNotNull()).select(F.col("node").cast("string"), F.col("parent").cast("string").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct()
    links.write.mode("overwrite").parquet(f"{path}/0")
    before = None
    for k in range(most_rounds):  # distances double: 2^40 generations
        now = spark.read.schema(schema).parquet(f"{path}/{k}")
        n = now.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if tuple(n) == before:
            return now
        before = tuple(n)
        further = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.node")).select("a.node", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        now.unionByName(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).write.mode("overwrite").parquet(f"{path}/{k + 1}")
    raise ValueError("ancestry did not settle")


def ends(links: DataFrame, path: str, most_rounds: int = 64) -> DataFrame:
    """node, end, distance for each node that has a parent: the last of its line, which has no parent or isn't a node, and how far up it is; both NULL
    where the line runs into a cycle. links: node, parent (one row a node, roots with NULL); path: a folder that executors share.

    A row a node, whatever the length of the lines: each round doubles the steps that the open lines are followed for, by those of the node they
    have come to. A line that comes back to its node is a cycle, and so are all open lines once a round brings none to an end, as every line with
    an end passes nodes at each lesser distance from it."""
    spark, schema = links.sparkSession, "node string, end string, distance long, state string, open int"
    own = links.filter(F.col("parent").isNotNull()).select(F.col("node").cast("string"), F.col("parent").cast("string").alias("end"), F.lit(1).cast("long").alias("distance"))
    state = F.when(F.col("node") == F.col("end"), "cycle").when(F.col("_n").isNull(), "ended").otherwise("open")
    now = own.join(own.select(F.col("node").alias("_n")), F.col("end") == F.col("_n"), "left").withColumn("state", state)
    closed = None
    for k in range(most_rounds):  # distances double: 2^64 generations
        now.select("node", "end", "distance", "state", (F.col("state") == "open").cast("int").alias("open")).write.mode("overwrite").partitionBy("open").parquet(f"{path}/{k}")
        made = spark.read.schema(schema).parquet(f"{path}/{k}")
        left, ended = made.agg(F.count_if(F.col("open") == 1), F.count_if(F.col("state") == "ended")).first()
        settled, going = (made.filter(F.col("open") == x).drop("open") for x in (0, 1))
        closed = settled if closed is None else closed.unionByName(settled)
        if not left or not ended:
            line = lambda c: F.when(F.col("state") == "ended", F.col(c)).alias(c)
            return closed.unionByName(going).select("node", line("end"), line("distance"))
        step = closed.unionByName(going).select(F.col("node").alias("_n"), F.col("end").alias("_end"), F.col("distance").alias("_d"), F.col("state").alias("_s"))
        state = F.when((F.col("_s") == "open") & (F.col("_end") == F.col("node")), "cycle").otherwise(F.col("_s"))
        now = going.join(step, F.col("end") == F.col("_n")).select("node", F.col("_end").alias("end"), (F.col("distance") + F.col("_d")).alias("distance"), state.alias("state"))
    raise ValueError("ancestry did not settle")


def generations(hypotheses: DataFrame, path: str) -> DataFrame:
    """hypotheses (id, parent, body, seq: the order of arrival) with stage (why they are rejected: NULL for those that stay), root and generation (from 0).
    An id or body that came before is a repeat; a parent that isn't there, or is rejected, orphans what descends from it; a cycle has no root."""
    spark = hypotheses.sparkSession
    first = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("seq"))
    rows = hypotheses.withColumn("_first", first("id") == 1).withColumn("_digest", F.unhex(F.sha2(F.coalesce("body", F.lit("")), 256)))
    rows = rows.withColumn("_again", ~F.col("_first") | (first("_digest") > 1)).drop("_first", "_digest")
    rows.write.mode("overwrite").parquet(f"{path}/rows")  # each round reads it
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    links = rows.filter("NOT _again").select(F.col("id").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"))
    tops = links.filter(F.col("parent").isNull()).select(F.col("node").alias("end"), F.lit(True).alias("_there"))
    found = ends(links, f"{path}/ends").join(tops, "end", "left")
    out = rows.join(found, (rows["id"].cast("string") == found["node"]) & ~rows["_again"], "left")
    child = F.col("parent").isNotNull()
    stage = F.when(F.col("_again"), REPEATED).when(child & F.col("end").isNull(), CYCLIC).when(child & F.col("_there").isNull(), ORPHANED)
    own = out.withColumn("stage", stage).withColumn("root", F.when(F.col("stage").isNull(), F.coalesce("end", F.col("id").cast("string")))).withColumn("generation", F.when(F.col("stage").isNull(), F.coalesce("distance", F.lit(0).cast("long"))))
    return own.drop("_again", "node", "end", "distance", "_there")


def staged(rows: DataFrame, stages: dict[str, Column], name: str = "stage") -> DataFrame:
    """rows with the first of the stages whose condition doesn't hold (NULL counts as not held; NULL where all do); rows that have one already keep it."""
    failed = F.coalesce(*(F.when(~F.coalesce(hold, F.lit(False)), F.lit(stage)) for stage, hold in stages.items()))
    return rows.withColumn(name, F.coalesce(F.col(name), failed) if name in rows.columns else failed)


def funnel(rows: DataFrame, stages: list[str], name: str = "stage") -> DataFrame:
    """stage, entered, rejected, remaining: how many rows came to each stage, in the order given."""
    at = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col(name)).cast("int")
    counts = rows.groupBy(F.coalesce(at, F.lit(len(stages) + 1)).alias("_i")).agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.sparkSession.createDataFrame(list(enumerate(stages, 1)), "i int, stage string")
    joined = wanted.join(F.broadcast(counts), F.col("_i") >= F.col("i"), "left")  # a row for each stage
    out = joined.groupBy("i", "stage").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entered"), F.coalesce(F.sum(F.when(F.col("_i") == F.col("i"), F.col("n"))), F.lit(0)).alias("rejected"))
    return out.withColumn("remaining", F.col("entered") - F.col("rejected")).drop("i")
