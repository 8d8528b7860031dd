"""Byte-level byte-pair encoding and decoding by a file of ranks.

A text is parted into pre-tokens by a pattern. Two tiers give the ids of a pre-token. The
first is a minimal perfect hash over the vocabulary's byte strings: one displacement for each
bucket sends each string to a slot of its own among exactly as many slots as there are
strings; the bytes in the slot tell whether the pre-token is that string, whose rank is then the one id. The second is for
the rest: its bytes are a linked list, a heap holds the ranks of neighbouring pairs, and the pair of the least
rank (the leftmost of equal ones) is joined until no pair is in the vocabulary. That takes n log n
steps, whatever the text.

Texts are read in chunks of pre-tokens, so that memory doesn't grow with a text but by its ids. Distinct pre-tokens
of a chunk are looked up together; the ids of misses are remembered, up to a number of them, in each worker.

Defined cases: null and empty texts have no ids; a vocabulary must hold all single bytes; ids
that the vocabulary doesn't have are an error in decoding, null arrays of ids are empty bytes; repeated rows are coded
alike; an empty table gives no rows; other columns pass through (the added one is replaced).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import made, share, trim
from tidemark.llm.words import hash_words, mix, same_words

#: Strings in a bucket of the perfect hash, on average.
BUCKET = 4
#: Pre-tokens of a chunk, and misses that a worker remembers (some 200 bytes each).
CHUNK, KEPT = 1 << 18, 1 << 19
#: Signs up to which a miss is remembered.
KEPT_SIGNS = 32
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """A minimal perfect hash of byte strings with the rank of each: all arrays are by slot but `shift`, which is by bucket."""

    data: np.ndarray  # the strings' bytes
    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray
    shift: np.ndarray  # seed of a bucket; below 0: the slot of its only string, as -1 - slot
    seed: int
    pattern: str

    def __len__(self) -> int:
        return len(self.rank)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[(hashes % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, place(hashes, np.maximum(shift, 0), len(self)))

    def ranks_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of each string data[start:end], or -1."""
        slot = self.slots(hash_words(data, start, end, self.seed))
        same = same_words((data, start, end), (self.data, self.start[slot], self.end[slot]))
        return np.where(same, self.rank[slot], -1)


def place(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slots of hashes under a bucket's seed."""
    return (mix(hashes + (np.asarray(shift).astype(np.uint64) + np.uint64(1)) * _SPREAD) % np.uint64(n)).astype(np.int64)


def perfect_hash(strings: list[bytes], ranks: list[int], pattern: str) -> Vocabulary:
    """Buckets are placed from the largest on, each by the first seed that sends its strings to free slots; buckets of one
    string take the slots that are left."""
    n = len(strings)
    if not n or len(set(strings)) < n:
        raise ValueError("a vocabulary has one rank for each string, and at least one string")
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    for seed in range(100):
        hashes = hash_words(data, start, end, seed)
        if len(np.unique(hashes)) == n:
            break
    n_buckets = -(-n // BUCKET)
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=n_buckets)
    first = np.cumsum(size) - size
    shift, taken, slot = np.zeros(n_buckets, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-size, kind="stable").tolist():
        if size[b] < 2:
            break
        own = order[first[b] : first[b] + size[b]]
        for seeds in (np.arange(k, k + 64) for k in range(0, 1 << 40, 64)):
            spots = place(hashes[own][None, :], seeds[:, None], n)
            ordered = np.sort(spots, axis=1)
            good = ~taken[spots].any(1) & (np.diff(ordered, axis=1) > 0).all(1)
            if good.any():
                k = int(good.argmax())
                shift[b], slot[own] = seeds[k], spots[k]
                taken[spots[k]] = True
                break
    free = iter(np.flatnonzero(~taken).tolist())
    for b in np.flatnonzero(size == 1).tolist():
        at = next(free)
        shift[b], slot[order[first[b]]] = -1 - at, at
    by_slot = np.argsort(slot)
    return Vocabulary(data, start[by_slot], end[by_slot], np.array(ranks, np.int64)[by_slot], shift, seed, pattern)


def load(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of a file of lines `base64 rank` (read once, by the driver: a vocabulary is small), for all tasks."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return share(spark, perfect_hash([base64.b64decode(a) for a, _ in lines], [int(b) for _, b in lines], pattern))


class Coder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern)
        raw = vocabulary.data.tobytes()
        self.strings = {int(r): raw[a:b] for a, b, r in zip(vocabulary.start.tolist(), vocabulary.end.tolist(), vocabulary.rank.tolist())}
        self.wide = max(self.strings) + 1
        self.kept: dict[str, bytes] = {}  # ids of misses as 32-bit integers
        self.older: dict[str, bytes] = {}  # those of the generation before, which come back when they are met again

    @cached_property
    def byte(self) -> list[int]:
        """The ids of single bytes."""
        by = {s: r for r, s in self.strings.items() if len(s) == 1}
        if len(by) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        return [by[bytes([i])] for i in range(256)]

    @cached_property
    def joins(self) -> dict[int, int]:
        """By a pair of ids: the rank of what it makes. (Decoding needs none.)"""
        by = {s: r for r, s in self.strings.items()}
        return {by[s[:i]] * self.wide + by[s[i:]]: r for r, s in self.strings.items() for i in range(1, len(s)) if s[:i] in by and s[i:] in by}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes that aren't in the vocabulary as a whole."""
        n, joins, wide = len(raw), self.joins.get, self.wide
        bits = n.bit_length()
        place = (1 << bits) - 1
        ids = [*map(self.byte.__getitem__, raw)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pair = [joins(a * wide + b, -1) for a, b in zip(ids, ids[1:])]  # by place: the rank that it and the next make
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & place, entry >> bits
            if pair[i] != rank:  # it was joined with another since
                continue
            j = after[i]
            ids[i] = rank
            ids[j] = pair[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = joins(rank * wide + ids[k], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = r = joins(ids[h] * wide + rank, -1)
                if r >= 0:
                    heappush(heap, r << bits | h)
        return [x for x in ids if x >= 0]

    def _miss(self, token: str, raw: bytes) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = array("i", self.merge(raw)).tobytes()
        if len(token) <= KEPT_SIGNS:
            self.kept[token] = ids
        return ids

    def ids_of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and how many each has."""
        index = dict.fromkeys(tokens)
        for i, token in enumerate(index):
            index[token] = i
        codes = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        distinct = list(index)
        raw = [token.encode() for token in distinct]
        end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        rank = self.vocabulary.ranks_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end)
        missed = np.flatnonzero(rank < 0)
        if len(self.kept) > KEPT // 2:
            self.kept, self.older = {}, self.kept
        kept = self.kept.get
        found = [kept(distinct[i]) or self._miss(distinct[i], raw[i]) for i in missed.tolist()]
        count = np.ones(len(distinct), np.int64)
        count[missed] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ends = np.cumsum(count)
        flat = np.repeat(rank, count)
        flat[np.repeat(rank < 0, count)] = np.frombuffer(b"".join(found), np.int32)
        sizes = count[codes]
        total = np.cumsum(sizes)
        where = np.repeat((ends - count)[codes] - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)
        return flat[where].astype(np.int32), sizes

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; short texts are looked up together, long ones chunk by chunk."""
        waiting: list[str] = []
        counts: list[int] = []
        for text in texts:
            if len(text or "") >= CHUNK:
                yield from self._spread(waiting, counts)
                waiting, counts, parts = [], [], [np.zeros(0, np.int32)]
                found = (m[0] for m in self.find.finditer(text))
                while tokens := list(islice(found, CHUNK)):
                    parts.append(self.ids_of(tokens)[0])
                yield np.concatenate(parts)
                continue
            tokens = self.find.findall(text or "")
            waiting += tokens
            counts.append(len(tokens))
            if len(waiting) >= CHUNK:
                yield from self._spread(waiting, counts)
                waiting, counts = [], []
        yield from self._spread(waiting, counts)

    def _spread(self, tokens: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        if not counts:
            return
        ids, sizes = self.ids_of(tokens) if tokens else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)].tolist()
        yield from (ids[a:b] for a, b in zip([0, *ends], ends))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


def encode(docs: DataFrame, vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of each text (array<int>). vocabulary: from load()."""

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        parts = list(made(vocabulary, Coder).encode(column.to_pylist()))
        ends = np.cumsum([0, *map(len, parts)])
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))
        trim()
        return out

    return docs.withColumn(into, of(F.col(text)))


def decode(coded: DataFrame, vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """coded with the bytes that its ids stand for (binary; UTF-8 again where ids are those of a whole text)."""

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        coder = made(vocabulary, Coder)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n.as_py() or 0 for n in column.value_lengths())])
        return pa.array([coder.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.binary())

    # not the bare column: a call on what encode() made would be run as one with it, and encode() twice
    return coded.withColumn(into, of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
