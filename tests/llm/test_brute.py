"""Rows of the queries that SQL cannot express, and of the pipeline, against plain Python."""

from __future__ import annotations

import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text import brute_hits, shingle_set
from tidemark.llm import html_extract, langid, quality, queries
from tidemark.llm.common import read_table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# Main text: recursion over the page instead of passes over arrays ------------------------------------


def log_odds(trees, row) -> float:
    out = trees.base
    for feature, limit, leaf in zip(trees.features, trees.limits, trees.leaves):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > limit[at])
        out += leaf[at - len(feature)]
    return out


def terms(odds: float) -> tuple[float, float]:
    x = max(-6.0, min(6.0, odds))
    return -math.log1p(math.exp(-x)), -math.log1p(math.exp(-x)) - x


def kids(node):
    return [k for k in node.items if isinstance(k, html_extract.Node)]


def own_text(node) -> bool:
    return any(isinstance(k, tuple) and not k[0].isspace() for k in node.items)


STATES: dict = {}  # by node of the page at hand: values of all in, all out and the best


def labellings(node, odds):
    """(value, {index: whether its own text is in}) of every allowed labelling of a subtree."""

    def whole(n, state):
        yes, no = terms(odds[n.index])
        value, marks = (yes if state else no), {n.index: state}
        for k in kids(n):
            v, m = whole(k, state)
            value, marks = value + v, marks | m
        return value, marks

    out = [whole(node, True), whole(node, False)]
    if kids(node):
        yes, no = terms(odds[node.index])
        base = -0.3 + (max(yes, no) if own_text(node) else max(yes, no, -0.2))
        for parts in itertools.product(*(labellings(k, odds) for k in kids(node))):
            marks = {node.index: odds[node.index] > 0}
            for _, m in parts:
                marks |= m
            out.append((base + sum(v for v, _ in parts), marks))
    return out


def test_decoding_takes_the_best_of_all_labellings():
    rng = random.Random(2)
    shapes = ["<div><p>a</p><p>b</p></div><p>c</p>", "<div>x<div><p>a</p></div></div><p>b</p>", "<ul><li>a<li>b</ul><div><div>c</div></div>"]
    for _ in range(60):
        nodes = html_extract.parse(rng.choice(shapes))
        odds = [rng.uniform(-8, 8) for _ in nodes]
        kept = html_extract.decode(nodes, odds)
        all_ = labellings(nodes[0], odds)
        best = max(v for v, _ in all_)
        assert kept in [[m[i] for i in range(len(nodes))] for v, m in all_ if v >= best - 1e-9]


def marks(node, odds, state=None, out=None):
    out = {} if out is None else out
    if state is None:
        plus, minus, best = STATES[node.index]
        state = True if best == plus else False if best == minus else None
    out[node.index] = odds[node.index] > 0 if state is None else state
    for k in kids(node):
        marks(k, odds, state, out)
    return out


def states(node, odds):
    yes, no = terms(odds[node.index])
    below = [states(k, odds) for k in kids(node)]
    plus, minus = yes + sum(b[0] for b in below), no + sum(b[1] for b in below)
    divided = sum(b[2] for b in below) - 0.3 + (max(yes, no) if own_text(node) else max(yes, no, -0.2)) if below else -math.inf
    STATES[node.index] = plus, minus, max(plus, minus, divided)
    return STATES[node.index]


def text_of(node, kept, out):
    """Blocks of a subtree by recursion; a list of open pieces is closed by each block."""
    for item in node.items:
        if isinstance(item, tuple):
            if kept[node.index]:
                out[-1].append(item[0])
        else:
            out.append([])
            if item is not None:
                text_of(item, kept, out)
                out.append([])
    return out


def test_main_text_query_by_recursion(spark):
    trees = html_extract.stored()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op1_html_main_text(spark, DATA).collect()}
    pages = read_table(spark, DATA, "pages").collect()
    assert len(got) == len(pages)
    for page in pages[:60]:
        nodes = html_extract.parse(page["html"] or "")
        odds = [log_odds(trees, row) for row in html_extract.features(nodes)]
        STATES.clear()
        states(nodes[0], odds)
        top = STATES[0][2]
        kept = marks(nodes[0], odds, None if top not in STATES[0][:2] else top == STATES[0][0])
        blocks = [" ".join("".join(b).split()) for b in text_of(nodes[0], kept, [[]])]
        want = "\n\n".join(b for b in blocks if b)
        assert got[page["page_id"]] == (want, len(want))


# Language: dictionaries instead of sorted arrays -------------------------------------------------------


def plain_languages(rows, order: int = 4):
    """Language models from (lang, text) rows as dictionaries; and a function: cross-entropies of a text, and its events."""
    counts: dict = {}
    for lang, text in rows:
        own = counts.setdefault(lang, Counter())
        for token in text.split():
            for w in langid.words_of(token):
                w = f"{langid.START}{w}{langid.END}"
                for i in range(2, len(w) + 1):
                    own[w[max(0, i - order) : i]] += 1
    models = {lang: langid.kneser_ney(dict(c), order, langid.ALPHABET) for lang, c in sorted(counts.items())}

    def entropies(text):
        sums, events = dict.fromkeys(models, 0.0), 0
        for token in text.split():
            for w in langid.words_of(token):
                w = f"{langid.START}{w}{langid.END}"
                events += len(w) - 1
                for lang, (grams, contexts, unknown) in models.items():
                    for i in range(1, len(w)):
                        g, back = w[max(0, i - order + 1) : i + 1], 0.0
                        while g and g not in grams[len(g) - 1]:
                            back += contexts[len(g) - 1].get(g[:-1], 0.0)
                            g = g[1:]
                        sums[lang] -= back + (grams[len(g) - 1][g] if g else unknown)
        return {k: v / max(events, 1) for k, v in sums.items()}, events

    return entropies


def learned_rows(docs):
    """The rows whose n-grams a fit counts, where nothing is beyond its sample."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(5))
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "text", part.alias("part")).collect()
    few = {k for k, n in Counter(r["lang"] for r in rows).items() if n < langid.SPARED_FROM}
    return [(r["lang"], r["text"]) for r in rows if r["part"] > 0 or r["lang"] in few]


def test_language_query_by_dictionaries(spark):
    docs = read_table(spark, DATA, "documents")
    entropies = plain_languages(learned_rows(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)))
    got = {r["doc_id"]: r for r in queries.op3_language_kneser_ney(spark, DATA).collect()}
    for d in docs.filter("doc_id % 2 = 0").select("doc_id", F.substring("text", 1, 10**9).alias("text")).collect():
        r, (sums, events) = got[d["doc_id"]], entropies(d["text"] or "")
        if not events:
            assert (r["lang_pred"], r["score"], r["entropy"]) == ("und", 0.0, None)
            continue
        assert r["lang_pred"] == min(sums, key=lambda k: (sums[k], k)) and r["entropy"] == pytest.approx(min(sums.values()), rel=1e-4)
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)


# Quality: a loop over pieces ---------------------------------------------------------------------------------------------


def plain_quality(model):
    def size(raw, piece):
        own = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_dict_id=False, write_content_size=False)
        return len(own.compress(piece))

    def score(text):
        raw = (text or "").encode()
        pieces = [raw[i : i + 512] for i in range(0, len(raw), 512)] or [b""]
        difference = sum(size(model.bad, p) - size(model.good, p) for p in pieces) / (len(raw) + 16)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.curve[0] + model.curve[1] * difference))))

    return score


def test_quality_query_by_a_loop(spark):
    docs = read_table(spark, DATA, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, DATA, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    score = plain_quality(model)
    got = {r["doc_id"]: r for r in queries.op9_quality_compression(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        want = score(d["text"])
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(want, rel=1e-9) and r["predicted"] == int(want >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


# The pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_rows_by_plain_stages(spark):
    docs = read_table(spark, DATA, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    learned = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    limits, entropies = langid.fit(learned), plain_languages(learned_rows(learned))
    left = {}
    for key, text in rows.items():
        sums, events = entropies(text or "")
        if events and not limits.scores(np.array([list(sums.values())]), np.array([events]))[1][0]:
            left[key] = text
    kept = spark.createDataFrame([(k, t) for k, t in left.items()], "doc_id long, text string")
    score = plain_quality(quality.fit(kept, read_table(spark, DATA, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)))
    left = {k: t for k, t in left.items() if score(t) >= 0.3}
    keys, sets = sorted(left), {k: shingle_set(t) for k, t in left.items()}
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    left = {k: left[k] for k in keys if find(k) == k or not sets[k]}
    items = [tuple(r) for r in read_table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    hits = brute_hits(list(left.items()), items, 13)
    left = {k: t for (k, t), h in zip(left.items(), hits) if not h[3]}
    got = {}
    for r in corpus_pipeline.run(spark, DATA).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert sorted(got) == sorted(left)
    for parts in got.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total
