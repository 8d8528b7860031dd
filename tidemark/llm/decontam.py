"""Benchmark decontamination by a prefix-filtered join of shingles.

An item's windows are its runs of `window` words (a shorter item is one window). A
window can only occur where all its shingles do, so its rarest shingle alone is its
necessary prefix: shingles are ordered by how often they occur in all documents
(one pass that counts), each window is filed under its rarest one, and the
documents' shingles are joined with that small table (second pass). A match gives
the only place where the window could stand; its bounds are checked against the
document's, then its words are compared one by one.

A match gives the only place where a window could begin, so a place is tested once for
each size of window, however many windows are filed there: equal windows are kept once,
beside the list of the items that hold them.

The item index is built for blocks of items whose texts are at most `block_bytes`
together, which bounds what is broadcast; more blocks mean more passes over the
documents. With several blocks only what was found (a digest of the text, a bit for each word,
the items) is written, for hit texts alone; no document is rewritten.

Defined cases: null, empty and wordless texts have no words and are clean; wordless
items match nothing; equal items each count; a null item id reads as an empty
string; repeated documents are judged alike; an empty table on either side gives no rows
or clean ones; other columns pass through (those named like the added ones are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, fresh, made, share, spans_of_rows, texts, trim
from tidemark.llm.words import BY_SIGN, Words, join, join_at, same_words, split

WINDOW = 13
#: Words of a shingle; windows of fewer words use all of theirs.
SHINGLE = 3
#: Hit texts up to which what was found in them is broadcast.
BROADCAST_ROWS = 200_000


class Lookup:
    """Positions of known 64-bit keys among many: a bit table first, then a sorted array."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(keys >> self.shift).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known keys stand in keys, and their indices."""
        at = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        if not len(at):
            return at, at
        index = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[index] == keys[at]
        return at[same], index[same]


@dataclass
class Index:
    """Distinct windows of a block of items, as arrays: about 100 bytes for each word of the items."""

    items: list[list[str]]  # ids of the items of each distinct sequence of words
    words: Words  # of those sequences
    vocabulary: tuple[np.ndarray, np.ndarray]  # sorted hashes of the words, and where each stands first
    start: np.ndarray  # of each window: its first word
    size: np.ndarray  # of each window: its words
    first: np.ndarray  # of each window: its first entry in holders, and the end
    holders: np.ndarray  # distinct sequences that hold the windows
    known: dict[int, tuple[np.ndarray, np.ndarray]]  # by size: sorted hashes of windows, and the windows
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by words a shingle: sorted hashes of all
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words a shingle: sorted hashes, first entry of each, entries (CODE * offset in the window + size of the window)
    seed: int = 0


#: Windows have fewer words than this, so that an offset and a size make one number.
CODE = 64


def windows_of(items: list[tuple[str, str]], window: int) -> Index:
    """Index of (id, text) pairs, yet without prefixes. Hashes are seeded anew until no two different words or windows share one."""
    for seed in range(16):
        index = _windows(items, window, seed)
        if index:
            return index
    raise RuntimeError("hashes of words collide")


def _windows(items: list[tuple[str, str]], window: int, seed: int) -> Index | None:
    if window >= CODE:
        raise ValueError(f"windows have fewer than {CODE} words")
    names: dict[bytes, list[str]] = {}
    for name, text in items:
        data, offsets = texts(pa.array([text], pa.string()))
        w = split(data, offsets, BY_SIGN)
        if len(w.hash):
            names.setdefault(b" ".join(data[a:b].tobytes() for data, a, b in ((w.data, a, b) for a, b in zip(w.start, w.end))), []).append(name)
    data, offsets = texts(pa.array([x.decode() for x in names], pa.string()))
    w = split(data, offsets, BY_SIGN, seed)
    hashes, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
    if not same_words((w.data, w.start, w.end), (w.data, w.start[at[which]], w.end[at[which]])).all():
        return None
    count = w.counts()
    n = np.maximum(count - window, 0) + 1 if len(count) else count
    item = np.repeat(np.arange(len(names)), n)
    start = w.first[:-1][item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(window, count[item])
    starts, sizes, firsts, holders, known, done = [], [], [np.zeros(1, np.int64)], [], {}, 0
    for k in np.unique(size).tolist():
        own = np.flatnonzero(size == k)
        keys, rep, inverse = np.unique(join_at(w.hash, start[own], k), return_index=True, return_inverse=True)
        rep = start[own][rep]
        if any((w.hash[start[own] + i] != w.hash[rep[inverse] + i]).any() for i in range(k)):
            return None
        held = np.unique(np.stack([inverse, item[own]]), axis=1)
        starts.append(rep)
        sizes.append(np.full(len(rep), k))
        firsts.append(np.cumsum(np.bincount(held[0], minlength=len(rep))) + firsts[-1][-1])
        holders.append(held[1])
        known[k] = keys, done + np.arange(len(rep))
        done += len(rep)
    none = np.zeros(0, np.int64)
    index = Index(list(names.values()), w, (hashes, at), np.concatenate([none, *starts]), np.concatenate([none, *sizes]), np.concatenate(firsts), np.concatenate([none, *holders]), known, seed=seed)
    for k in np.unique(np.minimum(SHINGLE, index.size)).tolist():
        index.shingles[k] = np.unique(np.concatenate([join_at(w.hash, places.ravel(), k) for _, places in _places(index, k)]))
    return index


def _places(index: Index, k: int):
    """(windows, first words of their shingles) for each size of windows whose shingles have k words."""
    for size in np.unique(index.size[np.minimum(SHINGLE, index.size) == k]).tolist():
        own = np.flatnonzero(index.size == size)
        yield own, index.start[own][:, None] + np.arange(size - k + 1)


def file_windows(index: Index, counts: dict[int, np.ndarray]) -> None:
    """File each window under its rarest shingle (ties: the lesser hash)."""
    for k, known in index.shingles.items():
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, counts[k]))] = np.arange(len(known))
        entries = []
        for own, places in _places(index, k):
            keys = join_at(index.words.hash, places.ravel(), k).reshape(places.shape)
            least = rank[np.searchsorted(known, keys)].argmin(1)
            entries.append(np.stack([keys[np.arange(len(own)), least], (least * CODE + index.size[own]).astype(np.uint64)]))
        key, code = np.unique(np.concatenate(entries, axis=1), axis=1)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        index.prefixes[k] = key[first], np.append(first, len(key)), code.astype(np.int64)


def inside(w, at: np.ndarray, k: int) -> np.ndarray:
    """Rows of the positions whose k words end within their row; -1 for others."""
    row = np.searchsorted(w.first, at, side="right") - 1
    return np.where(at + k <= w.first[row + 1], row, -1)


def count_shingles(docs: DataFrame, index: Index, text: str) -> dict[int, np.ndarray]:
    """How often each of the index's shingles occurs in all documents."""
    shared, seed = share(docs.sparkSession, index.shingles), index.seed
    sizes = sorted(index.shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = made(shared, lambda s: {k: Lookup(v) for k, v in s.items()})
        sums = {k: np.zeros(len(tables[k].keys), np.int64) for k in sizes}
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for a, b in spans_of_rows(offsets):
                w = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SIGN, seed)
                for k in sizes:
                    at, which = tables[k].find(join(w.hash, k))
                    sums[k] += np.bincount(which[inside(w, at, k) >= 0], minlength=len(sums[k]))
        for k in sizes:
            some = np.flatnonzero(sums[k])
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(sums[k][some])], ["k", "i", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in index.shingles.items()}
    for r in docs.select(text).mapInArrow(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # a row for each shingle of the block at most
        out[r["k"]][r["i"]] = r["n"]
    return out


def candidates(index: Index, tables: dict[int, Lookup], w: Words) -> Iterator[tuple[int, np.ndarray]]:
    """(size, places where windows of this size can begin) by prefixes and bounds, each place once."""
    parts = [np.zeros(0, np.int64)]
    for k, table in tables.items():
        _, first, codes = index.prefixes[k]
        at, which = table.find(join(w.hash, k))
        for i in range(0, len(at), 1 << 16):
            here, entry = at[i : i + (1 << 16)], which[i : i + (1 << 16)]
            n = first[entry + 1] - first[entry]  # at most one for each offset and size
            code = codes[np.repeat(first[entry] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            start, size, row = np.repeat(here, n) - code // CODE, code % CODE, np.repeat(inside(w, here, k), n)
            fits = (row >= 0) & (start >= w.first[row]) & (start + size <= w.first[row + 1])
            parts.append(np.unique(start[fits] * CODE + size[fits]))
    found = np.unique(np.concatenate(parts))
    for size in np.unique(found % CODE).tolist():
        yield size, found[found % CODE == size] // CODE


def occurrences(index: Index, tables: dict[int, Lookup], w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, windows) of all windows that occur, word by word."""
    places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, at in candidates(index, tables, w):
        keys, own = index.known[size]
        near = np.minimum(np.searchsorted(keys, key := join_at(w.hash, at, size)), len(keys) - 1)
        at, window = at[keys[near] == key], own[near[keys[near] == key]]
        same = np.ones(len(at), bool)
        for i in range(size):
            same &= w.hash[at + i] == index.words.hash[index.start[window] + i]
        places.append(at[same])
        windows.append(window[same])
    place, window = np.concatenate(places), np.concatenate(windows)
    # words that agree by hash are compared as bytes; windows over one that doesn't are dropped
    used = np.flatnonzero(covered(len(w.hash), place, index.size[window]))
    hashes, first = index.vocabulary
    theirs = first[np.searchsorted(hashes, w.hash[used])]
    bad = np.zeros(len(w.hash) + 1, np.int64)
    bad[used + 1] = ~same_words((w.data, w.start[used], w.end[used]), (index.words.data, index.words.start[theirs], index.words.end[theirs]))
    bad = np.cumsum(bad)
    right = bad[place + index.size[window]] == bad[place]
    return place[right], window[right]


def covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the spans."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


FOUND = "struct<n_words:bigint,n_hit:bigint,hits:binary,items:array<string>>"


def find_windows(shared, column: pa.Array) -> pa.StructArray:
    """Of each text: its words, those hit, a bit for each word (null without hits), and the sorted ids of items found."""
    index, tables = made(shared, lambda x: (x, {k: Lookup(p[0]) for k, p in x.prefixes.items()}))
    data, offsets = texts(column)
    n_words, n_hit, hits, items = [], [], [], []
    holds = np.zeros(len(index.items), bool)
    for a, b in spans_of_rows(offsets):
        w = split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SIGN, index.seed)
        place, window = occurrences(index, tables, w)
        hit = covered(len(w.hash), place, index.size[window])
        row = np.searchsorted(w.first, place, side="right") - 1
        pair = np.unique(row * max(1, len(index.size)) + window)
        row, window = pair // max(1, len(index.size)), pair % max(1, len(index.size))
        upto = np.searchsorted(row, np.arange(b - a + 1))
        for r in range(b - a):
            own = hit[w.first[r] : w.first[r + 1]]
            n_words.append(len(own))
            n_hit.append(int(own.sum()))
            hits.append(np.packbits(own).tobytes() if n_hit[-1] else None)
            if n_hit[-1]:
                holds[:] = False
                for x in window[upto[r] : upto[r + 1]].tolist():
                    holds[index.holders[index.first[x] : index.first[x + 1]]] = True
            items.append(sorted({name for i in np.flatnonzero(holds) for name in index.items[i]}) if n_hit[-1] else [])
    trim()
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["n_words", "n_hit", "hits", "items"])


def _hit_texts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """digest, hits, items of the texts (digest, text) that are hit."""
    for batch in batches:
        found = find_windows(shared, batch.column(1))
        own = pa.RecordBatch.from_arrays([batch.column(0), found.field("hits"), found.field("items")], ["digest", "hits", "items"])
        yield own.filter(own.column(1).is_valid())


def _merged(group: pa.Table) -> pa.Table:
    """One row of what the blocks found in one text: a row a block at most."""
    bits, items = None, set()
    for x, names in zip(group["hits"].to_pylist(), group["items"].to_pylist()):
        own = np.frombuffer(x, np.uint8)
        bits = own if bits is None else bits | own
        items.update(names)
    return pa.table({"digest": group["digest"][:1], "n_hit": pa.array([int(np.unpackbits(bits).sum())], pa.int64()), "items": pa.array([sorted(items)], pa.list_(pa.string()))})


def _n_words(column: pa.Array) -> pa.Array:
    data, offsets = texts(column)
    counts = [split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SIGN).counts() for a, b in spans_of_rows(offsets)]
    return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20, text: str = "text", item: str = "item_id", share_of_words: int = 20, into: str | None = None) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids) and contaminated (one word in share_of_words, or more, is hit);
    into: the name of one struct column for them."""
    spark = docs.sparkSession
    state_, at, named, own_ = fresh(docs, "state", "at", "digest", "own")
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("body")).distinct()
    size = own.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    digest, parts = F.sha2(F.coalesce(F.col(text), F.lit("")), 256), []
    for block in range(blocks):
        part = own if blocks == 1 else own.filter(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == block)
        index = windows_of([(r["id"], r["body"]) for r in part.collect()], window)  # about block_bytes of text
        file_windows(index, count_shingles(docs, index, text) if index.shingles else {})
        shared = share(spark, index)
        if blocks == 1:
            state = docs.withColumn(state_, F.arrow_udf(lambda column: find_windows(shared, column), FOUND)(F.col(text)))
            break
        hit = docs.select(digest.alias("digest"), F.col(text).alias("text")).mapInArrow(partial(_hit_texts, shared=shared), "digest string, hits binary, items array<string>")
        parts.append(cut(hit.dropDuplicates(["digest"]), "decontam"))
    else:
        all_ = reduce(DataFrame.union, [x for x, _ in parts])
        merged, _ = cut(all_.groupBy("digest").applyInArrow(_merged, "digest string, n_hit long, items array<string>"), "decontam")
        for _, path in parts:
            discard(spark, path)
        if merged.count() <= BROADCAST_ROWS:  # else a shuffled join
            merged = F.broadcast(merged)
        merged = merged.select(F.col("digest").alias(named), F.struct("n_hit", "items").alias(own_))
        state = docs.withColumn(at, digest).join(merged, F.col(at) == F.col(named), "left")
        found = F.struct(F.arrow_udf(_n_words, "bigint")(F.col(text)).alias("n_words"), F.coalesce(f"{own_}.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(f"{own_}.items", F.array().cast("array<string>")).alias("items"))
        state = state.withColumn(state_, found).drop(at, named, own_)
    n_words, n_hit = F.col(f"{state_}.n_words"), F.col(f"{state_}.n_hit")
    found = {"n_words": n_words, "n_hit": n_hit, "items": F.col(f"{state_}.items"), "contaminated": (n_hit > 0) & (n_hit * share_of_words >= n_words)}
    if into:
        return state.withColumn(into, F.struct(*(c.alias(k) for k, c in found.items()))).drop(state_)
    return state.withColumns(found).drop(state_)

