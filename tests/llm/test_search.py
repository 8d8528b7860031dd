"""Ranked search, byte-level BPE and the conversation trie against plain Python and the library."""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import documents, frame, prose
from tidemark.llm import bpe, queries, search, trie
from tidemark.llm.common import read_table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Ranked search -------------------------------------------------------------------------------------------


def terms(text):
    return [t.translate(str.maketrans(search.UPPER, search.LOWER)) for t in re.findall(search.TERMS, text or "")]


def brute_ranks(docs, items, top):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(str(i), k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block_bytes"), [(50, 16 << 20), (3, 16 << 20), (7, 300), (1, 16 << 20)])
def test_ranks_equal_brute_force(spark, top, block_bytes):
    rng = random.Random(top)
    docs = [(r[0], r[1]) for r in documents(n=60) if len(r[1] or "") < 50_000]
    docs += [(None, "no id again none whatsoever"), (-5, "no id again none whatsoever"), (-(2**63), "no id at all"), (2**63 - 1, "no id at all")]
    docs += [(1000 + k, "the same words in a large group of copies") for k in range(90)] + [(3000, "x" * 100_000 + " group"), (3001, "Group " * 40_000)]
    items = [(i, prose(rng, ("en", "de", "es")[i % 3], 25)) for i in range(8)] + [(8, "GROUP of the copies"), (9, None), (9, "no id"), (9, "ID of none"), (10, "..."), (11, "zzzzz"), (None, "words in no item"), (12, "éß 中文 12")]
    got = search.rank(frame(spark, [(d, t, None, None, 0) for d, t in docs], extra=True), spark.createDataFrame(items, "item_id long, text string"), top=top, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([(str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in got.collect()], key=str) == brute_ranks(docs, items, top)


def test_search_without_rows(spark):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert search.rank(frame(spark, []), items).count() == 0
    assert search.rank(frame(spark), items.limit(0)).count() == 0
    assert search.rank(frame(spark, [(1, None, None, None, 0), (2, "!!", None, None, 0)]), items).count() == 0
    with pytest.raises(ValueError):
        search.rank(frame(spark, []), items, top=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(-(2**40), 2**40)), max_size=200))
def test_radix_sums_equal_plain_ones(pairs):
    keys, values = np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int64)
    want = Counter()
    for k, v in pairs:
        want[k] += v
    got = search.summed(keys, values, 40)
    assert dict(zip(got[0].tolist(), got[1].tolist())) == dict(want) and (np.diff(got[0].astype(np.int64)) > 0).all()


def test_heaps_hold_the_best():
    rng, best, rows = np.random.default_rng(1), search.Best(3, 4), [[], [], []]
    for _ in range(60):
        item, score, has, key = rng.integers(0, 3, 20), rng.integers(1, 6, 20), rng.random(20) < 0.8, rng.integers(-50, 50, 20)
        for i, s, h, k in zip(item, score, has, key):
            rows[i].append((s, h, ~(k if h else 0)))
        best.offer(item, score, has, ~np.where(has, key, 0))
    for heap, all_ in zip(best.heaps, rows):
        assert sorted(heap, reverse=True) == heapq.nlargest(4, all_)


# Byte-level BPE ----------------------------------------------------------------------------------------------


def ranks():
    with open(queries.RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    own = ranks()
    return bpe.perfect_hash(list(own), list(own.values()), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(vocabulary):
    own = ranks()
    assert len(vocabulary) == len(own) and sorted(vocabulary.rank.tolist()) == sorted(own.values())  # as many slots as strings, each taken once
    names = [*own, *(k + b"~~" for k in list(own)[:5000]), b"", b"\xff\xfe\xfd" * 40]
    end = np.cumsum([len(x) for x in names])
    got = vocabulary.ranks_of(np.frombuffer(b"".join(names), np.uint8), end - [len(x) for x in names], end)
    assert got.tolist() == [own.get(x, -1) for x in names]
    with pytest.raises(ValueError):
        bpe.perfect_hash([b"a", b"a"], [0, 1], "")
    with pytest.raises(ValueError):
        list(bpe.Coder(bpe.perfect_hash([b"a"], [0], r"\S+")).encode(["ab"]))
    small = bpe.perfect_hash([bytes([i]) for i in range(256)], list(range(256)), r"\S+|\s+")
    assert next(iter(bpe.Coder(small).encode(["é b"]))).tolist() == [*"é b".encode()]


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=80), st.text("ab 's\n\t1é中!", max_size=120)), max_size=8))
def test_ids_equal_the_library(vocabulary, library, texts):
    coder = bpe.Coder(vocabulary)
    got = [x.tolist() for x in coder.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts] and [coder.decode(x) for x in got] == [t.encode() for t in texts]


def test_long_pretokens_and_texts_in_chunks(vocabulary, library, monkeypatch):
    texts = ["a" * 100_000, "é" * 30_000, " " * 20_000, "x" + "\n" * 5000 + "y", None, "", "ab cd " * 3000, "!?" * 9000]
    want = [library.encode_ordinary(t or "") for t in texts]
    assert [x.tolist() for x in bpe.Coder(vocabulary).encode(texts)] == want
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "KEPT", 3)
    assert [x.tolist() for x in bpe.Coder(vocabulary).encode(texts)] == want


def test_bpe_of_all_documents(spark, library):
    shared = bpe.load(spark, str(queries.RANKS), public_tokenizers.PATTERN)
    df = frame(spark, extra=True).withColumn("ids", F.lit("own"))
    rows = bpe.decode(bpe.encode(df, shared), shared).collect()
    assert len(rows) == len(documents()) and rows[0]["score"] == "own"
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    none = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "k int, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(none, shared).orderBy("k").collect()] == [b"!\"", b"", b""]
    assert bpe.encode(frame(spark, []), shared).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_bpe_query_by_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, DATA, "documents").collect()}
    rows = queries.op12_byte_level_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# Conversation trie -----------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """{node's path: values} of conversations {id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in rows.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(trie.WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rows[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    flat = [(c, d + 1, f"{role}:{text}", len(re.findall(trie.WORD, text))) for c, turns in rows.items() for d, (role, text) in enumerate(turns)]
    found = trie.build(spark.createDataFrame(flat, "conv_id long, depth long, turn_key string, words long"), spark.createDataFrame([(c,) for c in rows], "conv_id long"))
    digests = trie.ends_digest(found.ends)
    own = found.nodes.join(digests, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted([tuple(r) for r in own.collect()], key=str)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    rng = random.Random(6)
    turns = [(r, t) for r in ("user", "assistant") for t in ("", "one", "two words", "three \t words \x0b here")]
    rows = {rng.randrange(-50, 10**6): [rng.choice(turns) for _ in range(rng.randrange(6))] for _ in range(80)}
    long = [("user", f"turn {k}") for k in range(40)]
    rows |= {7: long, 8: long, 9: long[:20], 10: long[:3] + [("user", "else")] + long, 11: long[:3] + [("user", "else")] + long} | {100 + k: [("user", "hi"), ("assistant", "copy of it")] for k in range(60)}
    assert built(spark, rows) == brute_trie(rows)


@pytest.mark.parametrize("rows", [{}, {5: []}, {5: [], 3: []}, {4: [("user", "a b"), ("assistant", "c")]}, {4: [("user", "a b")] * 9, 2: [("user", "a b")] * 9}, {1: [], 2: [("user", "a")]}])
def test_small_tries(spark, rows):
    assert built(spark, rows) == brute_trie(rows)


def test_places_of_odd_turns_and_hot_conversations(spark):
    rng = random.Random(3)
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(c, rng.choice((None, 0, 1, 2)), rng.choice((None, "user")), rng.choice((None, "", "a b", "c"))) for c in range(2, 60) for _ in range(rng.randrange(5))]
    rows += [(None, 0, "user", "lost"), (70, 0, "user", "twice"), (70, 0, "user", "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(5)
    placed, _ = trie.turns_of(df)
    got = sorted((r["conv_id"], r["place"], r["turn_key"], r["words"]) for r in placed.collect())

    def key(role, text):
        return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()

    want = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            want[c].append((turn is not None, turn or 0, key(role, text), len((text or "").split())))
    assert got == sorted((c, i + 1, x[2], x[3]) for c, all_ in want.items() for i, x in enumerate(sorted(all_)))
    with_members = trie.regrouped(placed)
    assert sorted(r["conv_id"] for r in with_members[1].collect()) == sorted(want)
    assert trie.turns_of(df.limit(0))[0].count() == 0
