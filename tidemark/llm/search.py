"""Ranked lexical search by sort-based accumulation.

A set of items (queries) is ranked against all documents. A term is a run of digits,
letters of a-z (A-Z count as such) and signs beyond ASCII. Its weight w is
floor(1000 * ln((2N + 2) / (2df + 1))), of N documents with terms and df with this one; in a document where it occurs tf
times it has the impact w * (10^9 tf div (1000 tf + 20 m)), with m = 50 + 50 n N div L for a document of n terms and L terms in
all. All but w is 64-bit integers. An item's score in a document is the sum of its terms' impacts.

Two passes, neither of which shuffles documents. The first reads the texts and writes which of the items' terms each
document holds, how often, and its length; N, L and df follow from that table. The second reads the table alone: in each step it
concatenates item, document and impact of all matches, radix-sorts packed (document, item) keys, sums
runs with numpy's reduceat, and keeps each item's best in a heap. A document is whole in one task, so a task's heaps are exact for
its documents. An item's worst place over all tasks' full heaps bounds the final places from below: what is beneath it
goes before the rest is range-partitioned by item and ranked.

Items are stated queries: their distinct terms are handled in blocks of `block_bytes` (whole items), which each task gets; each further block
costs both passes again.

Defined cases: null and empty texts have no terms; documents without terms count for nothing; rows of one item id are one item, whose terms
count once (a null id is an item, too); a repeated document row is ranked again; of equal scores the
least document id comes first, null ids last; items or documents without rows give no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, share, spans_of_rows, texts, trim
from tidemark.llm.words import BY_SIGN, hash_words, same_words, split

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Matches that one step accumulates, about; its arrays take some 100 bytes for each.
STEP = 1 << 20

MATCHED = "key long, n long, terms array<int>, tfs array<long>"
TOPS = "item int, place int, key long, score long"


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys below 2^bits: a pass for each 16 bits, from the least on (numpy sorts those by radix)."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed(keys: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = radix_order(keys, bits)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


@dataclass
class Index:
    """The terms of a block of items: sorted by hash, with the items that hold each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    seed: int
    first: np.ndarray  # a term's first place in items; one more for the end
    items: np.ndarray
    n_items: int

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, words) -> np.ndarray:
        """The term of each word, or -1."""
        if not len(self):
            return np.full(len(words.hash), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self) - 1)
        hit = np.flatnonzero(self.hash[at] == words.hash)
        same = same_words((words.data, words.start[hit], words.end[hit]), (self.data, self.start[at[hit]], self.end[at[hit]]))
        out = np.full(len(words.hash), -1, np.int64)
        out[hit[same]] = at[hit[same]]
        return out


def index_of(pairs: list[tuple[int, str]], n_items: int) -> Index:
    """Index of (item, term) pairs without repeats."""
    names = sorted({t for _, t in pairs})
    raw = [t.encode() for t in names]
    end = np.cumsum([len(x) for x in raw], dtype=np.int64)
    start = end - np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    for seed in range(100):
        hashes = hash_words(data, start, end, seed)
        if len(np.unique(hashes)) == len(hashes):
            break
    by_hash = np.argsort(hashes)
    at = {names[j]: i for i, j in enumerate(by_hash.tolist())}
    term, item = np.array([at[t] for _, t in pairs], np.int64), np.array([i for i, _ in pairs], np.int64)
    order = np.lexsort((item, term))
    first = np.searchsorted(term[order], np.arange(len(names) + 1))
    return Index(data, start[by_hash], end[by_hash], hashes[by_hash], seed, first, item[order], n_items)


def _match(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index = shared.value[1]
    bits = max(1, len(index)).bit_length()
    for batch in batches:
        data, offsets = texts(batch.column(1))
        for a, b in spans_of_rows(offsets):
            found = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SIGN, index.seed)
            n = found.counts()
            term = index.find(found)
            hit = np.flatnonzero(term >= 0)
            row = np.repeat(np.arange(b - a), n)[hit]
            packed = row.astype(np.uint64) << np.uint64(bits) | term[hit].astype(np.uint64)
            keys, tf = summed(packed, np.ones(len(hit), np.int64), bits + (b - a).bit_length())
            per = np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=b - a)
            ends = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array((keys & np.uint64((1 << bits) - 1)).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf))], ["key", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))
        trim()


class Best:
    """Each item's best documents so far, in heaps; and the place that full ones ask for."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_items)]
        self.score = np.full(n_items, 0, np.int64)  # of a full heap's worst; only scores above 0 count
        self.inverse = np.full(n_items, np.iinfo(np.int64).max, np.int64)  # ~id of that (or beyond any, so that a score of 0 never passes)
        self.known = np.zeros(n_items, bool)

    def offer(self, items: np.ndarray, scores: np.ndarray, has: np.ndarray, inverse: np.ndarray) -> None:
        floor = self.score[items]
        tied = (scores == floor) & self.known[items] & (inverse >= self.inverse[items])
        for i, entry in zip(items[(good := np.flatnonzero((scores > floor) | tied))].tolist(), zip(scores[good].tolist(), has[good].tolist(), inverse[good].tolist())):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.top:
                # a null id at the floor loses to any other id, so all ties are looked at then
                self.known[i], self.score[i], self.inverse[i] = True, heap[0][0], heap[0][2] if heap[0][1] else np.iinfo(np.int64).min

    def rows(self) -> pa.RecordBatch:
        out = [(i, k + 1, ~inverse if has else None, score) for i, heap in enumerate(self.heaps) for k, (score, has, inverse) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["item", "place", "key", "score"])


def _accumulate(batches: Iterator[pa.RecordBatch], shared, weights, top: int) -> Iterator[pa.RecordBatch]:
    index, (n_docs, n_terms, weight) = shared.value[1], weights.value[1]
    best = Best(index.n_items, top)
    bits = max(1, index.n_items - 1).bit_length()
    holders = np.diff(index.first)
    for batch in batches:
        key, n = batch.column(0), batch.column(1).to_numpy()
        has = ~np.asarray(key.is_null())
        inverse = ~key.fill_null(0).to_numpy()
        term, tf = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
        m = 50 + (50 * n * n_docs) // n_terms
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(ends))))
        matches = np.concatenate([[0], np.cumsum(holders[term])])[ends]
        for a, b in spans_of_rows(matches, STEP):
            own = term[ends[a] : ends[b]]
            count = holders[own]
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            upto = np.cumsum(count)
            where = np.repeat(index.first[own] - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)
            packed = np.repeat(row, count).astype(np.uint64) << np.uint64(bits) | index.items[where].astype(np.uint64)
            keys, scores = summed(packed, np.repeat(impact[ends[a] : ends[b]], count), bits + (b - a).bit_length())
            rows = (keys >> np.uint64(bits)).astype(np.int64) + a
            best.offer((keys & np.uint64((1 << bits) - 1)).astype(np.int64), scores, has[rows], inverse[rows])
        trim()
    yield best.rows()


def rank(docs: DataFrame, items: DataFrame, top: int = 50, block_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank (from 1), key and score of each item's `top` best documents of a score above 0, as a table in the shared folder."""
    if top < 1:
        raise ValueError("at least one place is needed")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    own = items.select(F.col(item).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.translate(item_text, UPPER, LOWER), F.lit(TERMS), 0))).alias("term")).distinct()
    pairs, gone = cut(own, "search-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    kind, parts = pairs.schema["id"].dataType.simpleString(), []
    for block in range(blocks):
        part = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        parts.append(_rank_block(docs, [(r["id"], r["term"]) for r in part.collect()], kind, top))  # block_bytes of terms, about
    discard(docs.sparkSession, gone)
    none = docs.sparkSession.createDataFrame([], f"id {kind}, rank int, key long, score long")
    out = none
    for part in parts:
        out = part if out is none else out.union(part)
    return out.select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score")


def _rank_block(docs: DataFrame, pairs: list[tuple], kind: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    ids = sorted({i for i, _ in pairs}, key=lambda x: (x is None, x if x is not None else 0))
    at = {x: k for k, x in enumerate(ids)}
    index = index_of([(at[i], t) for i, t in pairs], len(ids))
    shared = share(spark, index)
    matched, first = cut(docs.mapInArrow(partial(_match, shared=shared), MATCHED), "search-matched")
    n_docs, n_terms = matched.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index), np.int64)
    for r in matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # as many rows as the block has terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights = share(spark, (n_docs, n_terms, weight))
    tops, second = cut(matched.mapInArrow(partial(_accumulate, shared=shared, weights=weights, top=top), TOPS), "search-tops")
    order = [F.col("score"), F.col("key").isNotNull().alias("has"), F.bitwise_not(F.coalesce("key", F.lit(0))).alias("inverse")]
    floor = tops.filter(F.col("place") == top).groupBy("item").agg(F.max(F.struct(*order)).alias("floor"))
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, id {kind}")
    # both are of the block's items, at most one for 17 of its bytes
    left = tops.join(F.broadcast(floor), "item", "left").filter(F.col("floor").isNull() | (F.struct(*order) >= F.col("floor")))
    places = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    best = left.repartitionByRange("item").withColumn("rank", F.row_number().over(places)).filter(F.col("rank") <= top)
    out, _ = cut(best.join(F.broadcast(names), "item").select("id", "rank", "key", "score"), "search")
    for path in (first, second):
        discard(spark, path)
    return out
