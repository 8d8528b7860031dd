"""Packing of tokenised documents into sequences of a fixed capacity.

Each document's ids (with one closing id) are cut into pieces of the capacity and a
rest. Full pieces are sequences of their own. Rests are packed by first-fit
decreasing: a tournament tree over the bins' free room finds the first bin that
holds a piece in logarithmic time. Documents are dealt at random (by a hash of the
id and content) and each run of `group` documents is packed by itself, so a task
holds the rests of one group only, however documents are spread.

Only piece descriptions are shuffled, unless the ids themselves are asked for.

Defined cases: null and empty texts are documents of the closing id alone; repeated
rows are documents of their own; a null id is kept as null; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches

CAPACITY = 1024
CLOSING_ID = 0
#: Documents packed together.
GROUP = 8192
#: Signs on which both tokenizer libraries surely part text alike: no others take the fast way.
_COMMON = re.compile(r"[^\n\t\x20-\x7e\xa1-\xac\xae-ɏ‐-‧]")


class Encoder:
    """ids of texts by a tokenizer file of the tokenizers library, without added special tokens.

    Byte-level BPE files whose ids follow their merges are also run by tiktoken, which gives the
    same ids several times faster; texts with unusual signs always take the library itself."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast, self.special = None, set()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("truncation") and not model.get("dropout")
        if plain:
            vocab = model["vocab"]
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            first = min((vocab[a + b] for a, b in pairs), default=0)
            if all(vocab[a + b] == first + i for i, (a, b) in enumerate(pairs)):
                self.fast, self.special = self._tiktoken(vocab, {a["content"]: a["id"] for a in spec.get("added_tokens", [])})

    @staticmethod
    def _tiktoken(vocab: dict[str, int], added: dict[str, int]):
        import tiktoken

        # fixed values: byte-level BPE writes printable bytes as themselves, the others from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items() if token not in added}
        # fixed value: the pattern of byte-level pre-tokenisation
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), set(added)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _COMMON.search(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class Tournament:
    """Free room of bins, with the first bin of enough room by one descent."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and its room before; the room is taken."""
        room, at = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        before = room[at]
        room[at] = before - size
        slot, at = at - self.leaves, at // 2
        while at:
            most = room[2 * at] if room[2 * at] > room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
            at //= 2
        return slot, before


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each size; equal sizes keep their order."""
    tree, out = Tournament(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        slot, before = tree.place(sizes[i])
        out[i] = (slot, capacity - before)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids) of each piece."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        encode = encoder(tokenizer)

        def step(batch: pa.RecordBatch):
            keys, columns, packs = [], [[], [], [], [], []], []

            def full():
                arrays = [pa.array(np.array(c, np.int64)) for c in columns]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *arrays, *([pa.array(packs, pa.list_(pa.int32()))] if keep_ids else [])], names)

            for row, body in enumerate(batch.column(1)):
                ids = np.append(encode(body.as_py() or ""), np.uint32(CLOSING_ID))
                whole = crc_of(ids)
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    keys.append(row)
                    for c, v in zip(columns, (start, len(part), crc_of(part), len(ids), whole)):
                        c.append(v)
                    if keep_ids:
                        packs.append(part.astype(np.int32))
                if len(keys) >= 4096:
                    yield full()
                    keys, columns, packs = [], [[], [], [], [], []], []
            if keys:
                yield full()

        return step

    names = ["k", "start", "length", "ids_crc32", "doc_tokens", "doc_crc", *(["ids"] if keep_ids else [])]
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, doc_crc long" + ", ids array<int>" * keep_ids
    return map_batches(docs.select(key, text), make, schema).withColumnRenamed("k", key)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, keep_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset."""
    found = pieces(docs, tokenizer, capacity, keep_ids, text, key).withColumn("_deal", F.xxhash64(key, "doc_crc", "doc_tokens", F.lit(2)))
    dealt = found.repartition("_deal").sortWithinPartitions("_deal", key, "doc_crc", "start")
    # equal rows stand together, so the pieces of one document may mix with those of its like; each start occurs once for each
    fields = [f for f in found.schema.fields if f.name not in ("_deal", "doc_crc")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    columns = [found.columns.index(f.name) for f in fields]
    starts, lengths = found.columns.index("start"), found.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        held: list[pa.RecordBatch] = []
        seen = 0

        def packed():
            nonlocal base, held, seen
            table = pa.Table.from_batches(held).combine_chunks()
            size = table.column(lengths).to_numpy()
            full = size == capacity
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            sequence[full] = base + np.arange(full.sum())
            rest = np.flatnonzero(~full)
            placed = first_fit_decreasing(size[rest].tolist(), capacity)
            if placed:
                slot, at = np.array(placed).T
                sequence[rest], offset[rest] = base + full.sum() + slot, at
            base += int(full.sum()) + (max(b for b, _ in placed) + 1 if placed else 0)
            held, seen = [], 0
            out = pa.Table.from_arrays([*(table.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*(f.name for f in fields), "sequence_id", "offset"])
            yield from out.to_batches(max_chunksize=10_000)

        for batch in batches:
            at = 0
            first = np.flatnonzero(batch.column(starts).to_numpy() == 0)  # of documents
            while at < batch.num_rows:
                later = first[first >= at]
                end = int(later[group - seen]) if len(later) > group - seen else batch.num_rows
                held.append(batch.slice(at, end - at))
                seen += int(((first >= at) & (first < end)).sum())
                at = end
                if at < batch.num_rows or len(held) > 4096:
                    yield from packed()
        if held:
            yield from packed()

    return dealt.mapInArrow(run, schema)
