"""Prefix trie of conversations by partition refinement.

Every distinct sequence of first turns is a node; a conversation is a member of the nodes of all its prefixes.
Equal conversations are first pre-aggregated to one sequence with a count. Refinement then starts with
one class of all sequences, the root. Each round splits the classes that are still active by their members' next turn; a
part of one sequence is retired at once, as its remaining turns can only be a unary chain, which is
emitted whole, once, after the rounds. There are as many rounds as turns that any two different conversations share. Last, what
subtrees hold in sum is folded back level by level, from the deepest class to the root.

A class is named by its smallest member, and rounds carry sequence, class and turn digest only (never texts).
Rounds read one depth of the turns, which are stored in the order of depth. Splits are grouped minima and joins, so
no class is ever gathered anywhere; turns are numbered, and chains summed, in blocks, so that neither is a
conversation of any length.

Equal turns are equal SHA-256 digests of role and text; equal conversations agree in their
number of turns and in six sums of 40-bit hashes of (place, turn).

Defined cases: turns of a null turn number come first, equal numbers are ordered by the digest; null roles and texts
are empty; repeated rows are turns of their own; rows of a null conversation id are left out; no conversations give no nodes;
other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard

WORD = r"[^\x20\x09-\x0D]+"
#: Sums by which equal conversations are told, and bits of each of their terms (2^23 turns don't overflow a sum).
LANES, LANE_BITS = 6, 40
#: Turns of a chain that are summed in one task.
BLOCK = 4096
#: Ids that one piece of a list holds, at most.
PIECE = 1 << 15


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_key and words of every turn, as a table in the shared folder: its path is the second value."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    return places(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("turn_key").asc()])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range, and the place among its range's rows of one group (the first column)."""
    part, last, upto = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        at = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group)))) + 1
        if last == group[0]:
            at[: first[1] if len(first) > 1 else None] += upto
        last, upto = group[-1], at[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(group), part, np.int32)), pa.array(at)], [*batch.schema.names, "_range", "_at"])


def places(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, str]:
    """rows with place: 1, 2, 3 ... in a group (a long, not null), whatever a group's size; and the path of the table it is read from."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(group, *[c for c in rows.columns if c != group]).schema)
    ranged = rows.select(group, *[c for c in rows.columns if c != group]).repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    counted, path = cut(ranged.mapInArrow(_number, f"{kind}, _range int, _at long"), "places")
    sizes = counted.groupBy(group, "_range").agg(F.max("_at").alias("n"))
    over = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # only groups that cross the border of a range: fewer than two rows for each range
    before = sizes.withColumn("before", F.sum("n").over(over)).filter("before IS NOT NULL").drop("n")
    placed = counted.join(F.broadcast(before), [group, "_range"], "left")
    return placed.withColumn("place", F.col("_at") + F.coalesce("before", F.lit(0))).drop("_range", "_at", "before"), path


@dataclass
class Trie:
    """nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, words (of the last turn), saved_tokens;
    ends: conv_id, depth of the node at which each member ends. Both are read from tables in the shared folder."""

    nodes: DataFrame
    ends: DataFrame


def build(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of conversations. turns: conv_id, depth (1, 2 ... without gaps), turn_key, words; members: conv_id of each, once, also of those without turns."""
    spark, gone = turns.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = cut(df, f"trie-{name}")
        gone.append(path)
        return out

    lanes = [f"lane{k}" for k in range(LANES)]
    hashed = [F.shiftrightunsigned(F.xxhash64("turn_key", "depth", F.lit(k)), 64 - LANE_BITS).alias(x) for k, x in enumerate(lanes)]
    ones = turns.select("conv_id", F.lit(1).alias("n"), *hashed).union(members.select("conv_id", F.lit(0), *(F.lit(0).cast("long") for _ in lanes)))
    alike = kept(ones.groupBy("conv_id").agg(*(F.sum(x).alias(x) for x in ("n", *lanes))), "alike")
    sequences = kept(alike.groupBy("n", *lanes).agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("w")), "sequences")
    total = sequences.agg(F.min("seq"), F.sum("w"), F.count(F.lit(1))).first()
    narrow = turns.join(sequences.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("seq"), "depth", "turn_key", "words")
    deep = kept(narrow.repartitionByRange("depth", "seq").sortWithinPartitions("depth"), "turns")
    levels = [spark.createDataFrame([(total[0], None, total[1], 0, total[2], 0)] if total[2] else [], "conv_id long, parent long, n_convs long, words long, n_seqs long, n long")]
    ended, active = [], sequences.select("seq", "w", "n", F.lit(total[0]).cast("long").alias("conv_id"))
    while True:
        depth = len(levels) - 1
        ended.append(active.filter(F.col("n") == depth).select("seq", "conv_id", F.lit(depth).cast("long").alias("depth")))
        going = kept(active.filter(F.col("n") > depth).join(deep.filter(F.col("depth") == depth + 1).drop("depth"), "seq"), "going")
        split = going.groupBy(F.col("conv_id").alias("parent"), "turn_key").agg(F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n_seqs"), F.min("n").alias("n"))
        split = kept(split, "level")
        levels.append(split)
        if split.filter("n_seqs > 1").isEmpty():
            break
        parts = split.filter("n_seqs > 1").select(F.col("conv_id").alias("part"), "parent", "turn_key")
        joined = going.join(parts, (going.conv_id == parts.parent) & (going.turn_key == parts.turn_key))
        active = kept(joined.select("seq", "w", "n", F.col("part").alias("conv_id")), "active")
    # retired parts: the whole rest of each as a chain
    retired = reduce(DataFrame.union, [x.filter("n_seqs = 1").select(F.col("conv_id").alias("seq"), "parent", F.col("n_convs").alias("w"), "n", F.lit(k).cast("long").alias("from")) for k, x in enumerate(levels) if k])
    chains = kept(deep.select("seq", "depth", "words").join(retired, "seq").filter("depth >= from"), "chains")
    several = kept(_suffix_sums(chains.filter("w > 1").withColumn("own", (F.col("w") - 1) * F.col("words"))), "sums")
    columns = ["seq", "depth", "parent", "from", "w", "n", "words", "saved"]
    chains = several.select(*columns).union(chains.filter("w = 1").withColumn("saved", F.lit(0).cast("long")).select(*columns))
    # classes, from the deepest level back
    below, folded = None, []
    for depth in range(len(levels) - 1, -1, -1):
        heads = chains.filter((F.col("from") == depth) & (F.col("depth") == depth)).select("parent", F.lit(1).cast("long").alias("n_leaves"), "saved")
        own = levels[depth] if not depth else levels[depth].filter("n_seqs > 1")
        if below is not None:
            kids = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
            own = own.join(kids, "conv_id", "left")
        else:
            own = own.withColumns({x: F.lit(None).cast("long") for x in ("n_children", "below_leaves", "below_saved")})
        own = own.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("below_leaves", F.lit(1)).alias("n_leaves"), "words",
            ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("below_saved", F.lit(0))).alias("saved"),
        )
        folded.append(kept(own, "fold"))
        below = folded[-1].select("parent", "n_leaves", "saved").union(heads)
    parent = F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("seq"))
    unary = chains.select("seq", "depth", parent, F.col("w"), (F.col("depth") < F.col("n")).cast("long"), F.lit(1).cast("long"), "words", "saved")
    nodes = reduce(DataFrame.union, [*folded, unary]).toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "words", "saved_tokens")
    tails = retired.select("seq", F.col("seq").alias("conv_id"), F.col("n").alias("depth"))
    last = reduce(DataFrame.union, [*ended, tails])
    # each sequence's members, first those that are alone
    named = sequences.select("n", *lanes, "seq")
    of = alike.join(named, ["n", *lanes]).select("seq", F.col("conv_id").alias("member"))
    ends = of.join(last, "seq").select("conv_id", "depth", "member")
    out = Trie(cut(nodes, "trie-nodes")[0], cut(ends, "trie-ends")[0])
    for path in gone:
        discard(spark, path)
    return out


def _suffix_sums(rows: DataFrame) -> DataFrame:
    """rows with saved: the sum of `own` from a depth to its chain's end, by sums of blocks and within each block."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    deeper = Window.partitionBy("seq").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("seq", "block").agg(F.sum("own").alias("n")).withColumn("rest", F.coalesce(F.sum("n").over(deeper), F.lit(0))).drop("n")
    within = Window.partitionBy("seq", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("own").over(within)).join(blocks, ["seq", "block"]).withColumn("saved", F.col("upto") + F.col("rest"))


# Digests of member lists ---------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each node's list, from rows in order: (conv_id, depth, first member, members joined by commas)."""
    for batch in batches:
        node, depth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(node):
            continue
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(node)))
        more = -(-size // PIECE)  # long runs in several pieces
        inside = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        at = np.repeat(first, more) + inside * PIECE
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(at, len(node)), pa.int64()), batch.column(2).cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), batch.column(2).take(pa.array(at)), pc.binary_join(lists, ",").cast(pa.string())], ["conv_id", "depth", "first", "body"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in order, joined by commas."""
    now, state, rows = None, None, []
    for batch in batches:
        for node, depth, _, body in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (node, depth):
                if now:
                    rows.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256(body.encode())
            else:
                state.update(f",{body}".encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["conv_id", "depth", "ends_sha256"])
            rows = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """conv_id, depth and the hex SHA-256 of the members' decimal ids, ascending, joined by commas. A node's ids are sorted and joined in ranges; the pieces are what its
    one hash reads (a hash can only be taken in order)."""
    ranged = ends.select("conv_id", "depth", "member").repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    pieces = ranged.mapInArrow(_pieces, "conv_id long, depth long, first long, body string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashes, "conv_id long, depth long, ends_sha256 string")


def regrouped(placed: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations that take their first turns from another: conversation c begins with the first h turns of conversation
    c - c % group (all it has; none if it isn't there), h = CRC-32 of c's decimal text % most, and goes on with its own turns after its first h. placed: from turns_of()."""
    members = placed.filter("place = 1").select("conv_id")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    heads = placed.filter((F.col("place") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "turn_key", "words")
    asked = members.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = asked.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "turn_key", "words")
    got = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"))
    short = asked.join(got, "conv_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < h").select("conv_id", "got")
    rest = placed.withColumn("h", h).filter("place > h").join(short, "conv_id", "left")
    rest = rest.select("conv_id", (F.coalesce("got", "h") + F.col("place") - F.col("h")).cast("long").alias("depth"), "turn_key", "words")
    return first.union(rest), members
