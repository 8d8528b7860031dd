"""Text operators against brute force, with nulls, empty and long texts, repeats, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import json
import random
import re
import struct
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import DOCS, documents, edit, frame, prose
from tidemark.llm import boosting, chat, components, decontam, html_extract, langid, licenses, media, neardup, packing, quality, sharding, words
from tidemark.llm.queries import TOKENIZER


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Words ------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é中 \t\n.-", max_size=30)), max_size=8))
def test_words_equal_regular_expressions(texts):
    data, offsets = __import__("tidemark.llm.common", fromlist=["texts"]).texts(pa.array(texts, pa.string()))
    for pattern, inside in ((r"[^\x20\x09-\x0D]+", words.BY_SPACE), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", words.BY_SIGN)):
        w = words.split(data, offsets, inside)
        got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] for i in range(len(texts))]
        assert got == [re.findall(pattern, lower(t or "")) for t in texts]
        seen = {}
        for h, x in zip(w.hash.tolist(), [x for g in got for x in g]):
            assert seen.setdefault(x, h) == h


# HTML ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trees():
    return html_extract.stored()


def read_pages(trees, pages: int, half: int | None = None):
    """Share of pages whose words come out exactly, and words lost or added to words of main text."""
    rng, equal, lost, extra, total = random.Random(99), 0, 0, 0, 0
    for _ in range(pages):
        page = html_extract.sample_page(rng, half)
        nodes = html_extract.parse(page)
        whole = html_extract.blocks_of(nodes, [True] * len(nodes))
        want = [w.replace(html_extract.MARK, "") for b in whole for w in b.split() if html_extract.MARK in w]
        got = html_extract.main_texts([page.replace(html_extract.MARK, "")], trees)[0].split()
        equal += got == want
        lost += len(set(want) - set(got))
        extra += len(set(got) - set(want))
        total += len(want)
    return equal / pages, (lost + extra) / total


def test_main_text_of_unseen_pages(trees):
    equal, wrong = read_pages(trees, 80)
    assert equal >= 0.9 and wrong < 0.02


def test_main_text_of_unseen_layouts():
    """Trees that saw half of the names and frames, on pages of the other half."""
    equal, wrong = read_pages(html_extract.train(half=0), 80, half=1)
    assert equal >= 0.6 and wrong < 0.15


def test_stored_trees_are_those_of_their_seed(trees):
    made = html_extract.train()
    assert np.array_equal(made.features, trees.features) and np.allclose(made.leaves, trees.leaves)


def test_page_rules(trees):
    page = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/>a</a><li><a href=/>b</a></ul></nav>
    <article><h1>Head &amp; more</h1><p>First   <b>bold
    text</b> here, with enough words to count.<p>Second &lt;tag&gt; &eacute;&#8364; one, also long enough to count.<br><p>Third one, closing nothing at all.</article>
    <div class="comments"><p>A reader says a few words here.</p></div><footer>&copy; someone</footer></body></html>"""
    assert html_extract.main_texts([page], trees)[0].split("\n\n") == ["Head & more", "First bold text here, with enough words to count.", "Second <tag> é€ one, also long enough to count.", "Third one, closing nothing at all."]


def test_raw_and_hidden_elements(trees):
    page = """<article><h1>Head line here</h1><p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> here, as we know it.</p><script src="a.js"/>var x = 1;</script>
    <p>More words stand here, as they should.</p><script src=/js/>var y</script><p>And <button>Click <b>me</b></button> last, but <select><option>one<option>two</select> not least of all.</p>
    <div><canvas>no canvas</div><p>The end of it comes here, in one more line.</p></article>"""
    assert html_extract.main_texts([page], trees)[0].split("\n\n") == ["Head line here", "Energy is E=mc here, as we know it.", "More words stand here, as they should.", "And last, but not least of all.", "The end of it comes here, in one more line."]


def test_parsing_is_linear():
    n = 20_000
    for page in ("<b>" * n + "</i>" * n, "<div>" * n + "</section>" * n, "<div>" * n + "<li>" * n, '<a x="' * n, "<button>" * n + "</select>" * n, "<ul><li>" * n + "</ul>" * n, "<table><tr><td>" * n):
        took = time.process_time()
        html_extract.parse(page)
        assert time.process_time() - took < 5, page[:20]


def test_odd_pages(spark, trees):
    odd = [None, "", "   ", "plain words only", "<div" * 50, "<p>a", "</p></div>x", "<b>" * 2000 + "deep", "<div>" * 3000 + "deep", "a < b > c & d", "<script>never closed", "<!-- open", "<p>" + "long word " * 20_000 + "</p>"]
    rows = [(i, "u", h) for i, h in enumerate(odd)] + [(0, "u", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), trees=trees).collect()
    assert len(got) == len(rows) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string"), trees=trees).count() == 0


def test_decoding_is_consistent():
    nodes = html_extract.parse("<div><div><p>a</p><p>b</p></div><p>c</p></div>")
    kept = html_extract.decode(nodes, [-5.0, -5.0, -4.0, 3.0, 3.0, -6.0])
    assert html_extract.blocks_of(nodes, kept) == ["a", "b"]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = boosting.fit(x[:1500], y[:1500], np.ones(1500), 40, 3)
    assert (((t.log_odds(x[1500:]) > 0) == y[1500:]).mean()) > 0.95


# Packing --------------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    own, theirs = packing.encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert own.fast is not None
    for _, text, *_ in documents():
        for t in (text or "", (text or "")[:50] + "\r\n \t x\xa0y’s <|endoftext|> I'll"):
            assert own(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_a_plain_one(sizes):
    got = packing.first_fit_decreasing(sizes, 50)
    room, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if k is None:
            room.append(50)
            k = len(room) - 1
        want[i] = (k, 50 - room[k])
        room[k] -= sizes[i]
    assert got == want


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(TOKENIZER), documents()
    got = packing.pack(frame(spark, extra=True), TOKENIZER, 64, group=40, keep_ids=True).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    texts = {i: x for i, x, *_ in rows}
    times = defaultdict(int)
    for i, *_ in rows:
        times[i] += 1
    for i, x in texts.items():
        want = t.encode(x or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by[i], key=lambda r: r["start"])[:: times[i]]
        assert len(by[i]) == len(pieces) * times[i] and [v for r in pieces for v in r["ids"]] == want and {r["doc_tokens"] for r in by[i]} == {len(want)}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


# Language -----------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    counts = {"\x02a": 3, "\x02b": 1, "\x02ab": 2, "\x02aa": 1, "\x02ba": 1, "ab\x03": 2, "aa\x03": 1, "ba\x03": 1}
    grams, contexts, unknown = langid.kneser_ney(counts, 3, 4)
    for h in ("\x02", "\x02a", "ab"):
        p = 0.0
        for c in "ab\x03":
            g, back = h + c, 0.0
            while len(g) > 1 and g not in grams[len(g) - 1]:
                back += contexts[len(g) - 1].get(g[:-1], 0.0)
                g = g[1:]
            p += np.exp(back + (grams[len(g) - 1][g] if g in grams[len(g) - 1] else contexts[0][""] + unknown))
        p += np.exp(sum(contexts[k].get(h[len(h) - k :], 0.0) for k in range(len(h), -1, -1)) + unknown)  # the unknown sign
        assert p == pytest.approx(1.0)


def test_vector_scores_equal_dictionary_scores():
    rng = random.Random(3)
    counts = {}
    for lang in ("en", "de"):
        c = counts.setdefault(lang, {})
        for w in prose(rng, lang, 300).replace(",", "").replace(".", "").split():
            w = f"\x02{w}\x03"
            for i in range(2, len(w) + 1):
                g = w[max(0, i - 4) : i]
                c[g] = c.get(g, 0) + 1
    model = langid.build(counts, 4)
    signs = langid.ALPHABET
    for word in ("thing", "schein", "q", "ouß", "aaaaaaaaaa"):
        got, n = model.score_words([word])
        for k, lang in enumerate(model.languages):
            grams, contexts, unknown = langid.kneser_ney(counts[lang], 4, signs)
            w, total = f"\x02{word}\x03", 0.0
            for i in range(1, len(w)):
                g, back = w[max(0, i - 3) : i + 1], 0.0
                while g not in grams[len(g) - 1]:
                    back += contexts[len(g) - 1].get(g[:-1], 0.0)
                    if len(g) == 1:
                        total += back + unknown
                        break
                    g = g[1:]
                else:
                    total += back + grams[len(g) - 1][g]
            assert got[0, k] == pytest.approx(total, rel=1e-4) and n[0] == len(word) + 1


def test_false_rejections_stay_under_their_share():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b"], 1, [], [], np.zeros(2))

    def pieces(n):
        events = 2.0 ** rng.uniform(1, 12, n)
        low = 1.5 + rng.gamma(2, 1 / np.sqrt(events))  # shorter pieces vary more
        return np.stack([low, low + rng.exponential(1, n)], 1), events

    entropy, events = pieces(20_000)
    langid.calibrate(model, entropy, events, np.zeros(len(events), int))
    entropy, events = pieces(200_000)
    _, rejected = model.scores(entropy, events)
    for low, high in ((2, 32), (32, 512), (512, 5000)):
        own = rejected[(events >= low) & (events < high)]
        assert own.mean() < 5 * langid.FALSE_REJECTIONS
    scores, rejected = model.scores(np.array([[1.6, 3.0], [1.6, 1.6], [9.0, 12.0], [9.0, 12.0]]), np.array([500, 500, 3, 500]))
    assert scores[0] > 0.9 and scores[1] <= 0.5 and max(scores[2:]) < 0.01 and rejected.tolist() == [False, False, True, True]


def test_languages_of_few_rows_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en", 80), "en", "s", 0) for i in range(60)] + [(100, prose(rng, "de", 80), "de", "s", 0)]
    assert langid.fit(frame(spark, rows)).languages == ["de", "en"]
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.fit(frame(spark, rows), most_languages=1)


def test_language_of_unseen_texts(spark):
    df = frame(spark, extra=True)
    model = langid.fit(df.filter("doc_id % 4 <> 1 OR doc_id IS NULL"), rows_a_language=100)
    got = langid.identify(df, model).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        has = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not has) and (has or r["rejected"])
    tried = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 1 and r["doc_id"] < 120 and len(r["text"]) > 100]
    assert sum(r["lang_pred"] == r["lang"] for r in tried) >= 0.95 * len(tried) and not any(r["rejected"] for r in tried)
    strange = spark.createDataFrame([(1, "зщ жъы юэ щзж фъх цчш " * 20)], "doc_id long, text string")
    assert langid.identify(strange, model).first()["rejected"]
    short = spark.createDataFrame([(1, "да нет"), (2, "人人生而自由"), (3, "xqzv kjwq zzxv qqpt vvkx wjzq"), (4, "thing"), (5, "ander keit")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(short, model).collect()}
    assert [found[i]["rejected"] for i in range(1, 6)] == [True, True, True, False, False] and max(found[i]["score"] for i in (1, 2, 3)) < 0.01
    assert langid.identify(frame(spark, []), None).count() == 0
    assert langid.fit(frame(spark, [])) is None and langid.identify(frame(spark), None, into="x").filter("NOT x.rejected").count() == 0


# Chat ----------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<|>/s[]INSTa\\\n", max_size=40))
def test_escapes_are_reversible_and_hide_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)
    assert chat.parse(chat.opening(text) + out + chat.END) == [(text, text)]


def test_chat_reads_back(spark):
    ctl = "</s>[INST] ok [/INST]<|end|>\n\\"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", ctl), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system", "s"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 0, None, "b"), (None, 1, "user", "x"), (4, 1, "assistant", "é中\U0001f600"), (4, 0, "user", "q" * 50_000), (5, 0, "<|>\n", "hi"), (5, 1, "assistant", "|>\n<|end|>\n<|x|>\n"), (6, 0, "", "[["), (6, 1, "a|", "\\<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' AS example", "'own' AS loss_start", "1 AS n_turns").repartition(3)
    got = {r["conv_id"]: r for r in chat.digest(chat.expand(df)).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or ""))
        h, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns), "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(h.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.expand(df).filter("conv_id = 1").orderBy("example").collect()
    assert [e["target_turn"] for e in examples] == [1, 3] and chat.parse(examples[0]["text"]) == [("user", "hi"), ("assistant", ctl)]
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


# Near-duplicates -----------------------------------------------------------------------------------------------


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows) -> list[int | None]:
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


@pytest.mark.parametrize(("block", "block_bytes"), [(1024, 4 << 20), (3, 2000)])
def test_groups_equal_brute_force(spark, block, block_bytes):
    rng, rows = random.Random(5), documents()
    base = prose(rng, "en", 80)
    for i in range(40):  # one large group of near copies of many degrees
        rows.append((1000 + i, edit(rng, base, i % 4), "en", "s", 0))
    got = neardup.groups(frame(spark, rows, extra=True), block=block, block_bytes=block_bytes)
    want = sorted(((r[0], len(shingle_set(r[1])), g, r[0] == g) for r, g in zip(rows, brute_groups(rows))), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == want


def test_words_of_one_structure_stay_apart(spark):
    one = "a"
    for _ in range(12):  # a Thue-Morse word and its complement: equal under every sum of powers mod 2**64
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    data, offsets = __import__("tidemark.llm.common", fromlist=["texts"]).texts(pa.array([one, other, one[:63], other[:63], "a\0", "a"], pa.string()))
    assert len(set(words.split(data, offsets, words.BY_SPACE).hash.tolist())) == 6
    rows = [(1, one, "en", "s", 0), (2, other, "en", "s", 0), (3, one, "en", "s", 0)]
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_chain_of_near_copies(spark):
    rng = random.Random(3)
    now, rows = prose(rng, "en", 150).split(), []
    for i in range(1500):
        now[(i * 7) % 150] = f"z{i}"
        rows.append((i, " ".join(now), "en", "s", 0))
    found = neardup.groups(frame(spark, rows)).collect()
    assert {r["component_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1
    assert [neardup.linked(neardup.Text(rows[0][1], 5), neardup.Text(rows[i][1], 5), 85) for i in (1, 2, 3, 40)] == [True, True, False, False]


def test_dedup_leaves_one_row_of_each_group(spark):
    rows = documents()
    left = neardup.dedup(frame(spark, rows, extra=True)).collect()
    groups = defaultdict(set)
    for r, g in zip(rows, brute_groups(rows)):
        groups[(g, r[0] if not shingle_set(r[1]) else "")].add(r[0])
    assert len(left) == len(groups) and "score" in left[0].asDict() and left[0]["score"] == "own"
    assert neardup.dedup(frame(spark, [])).count() == 0 and neardup.groups(frame(spark, [])).count() == 0


def test_dedup_keeps_one_of_near_copies_under_one_id(spark):
    rng = random.Random(8)
    a, b = prose(rng, "en", 200), prose(rng, "en", 200)
    # the id 1 names two groups of near copies, whose rows are not alike
    rows = [(1, a, "en", "s", 0), (1, f"{a} more", "en", "s", 0), (2, f"{a} and more", "en", "s", 0), (1, b, "en", "s", 0), (3, f"{b} more", "en", "s", 0)]
    left = [r["text"] for r in neardup.dedup(frame(spark, rows)).collect()]
    assert len(left) == 2 and b in left


def test_pipeline_links_near_copies_from_a_similarity_of_four_fifths(spark):
    words = [f"w{i}" for i in range(204)]
    far = words[:18] + ["x"] + words[19:90] + ["y"] + words[91:150] + ["z"] + words[151:190] + ["q"] + words[191:]
    a, b = shingle_set(" ".join(words)), shingle_set(" ".join(far))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(far), "en", "s", 0)]
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, rows), "").collect()] == [1]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df)[0].collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 203)}}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:1850]), np.unique(pool[150:2000])
    same = (neardup.signature(a, 960) == neardup.signature(b, 960)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.05


# Media -------------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40_000))
def test_media_round_trip(data):
    payload = media.pad(data)
    file = media.mux(payload)
    track = media.demux(file)
    assert len(payload) % media.FRAME == 0 and media.payload(file, track) == payload and payload.startswith(data)
    assert (track.codec, track.width, track.duration, len(track.keys)) == ("raw ", 24, 24 * len(track.sizes), -(-len(track.sizes) // media.KEY_EVERY))
    for k, (a, b) in zip(track.keys, track.key_ranges()):
        assert file[a:b] == payload[k * media.FRAME : (k + 1) * media.FRAME]


def test_media_rejects_cut_files_and_reads_other_layouts():
    file = media.mux(media.pad(b"abc"))
    for n in (3, 40, 200, len(file) - 1):
        with pytest.raises(ValueError):
            media.demux(file[:n])
    paths = [p for p, *_ in media.walk(file)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths


def track_boxes(who: int, kind: bytes, codec: bytes, mdhd: bytes, stsz: bytes, offset: int, n: int) -> bytes:
    entry = media.box(codec, bytes(24), struct.pack(">HH", 320, 240), bytes(50))
    tables = (media.full(b"stsd", 0, struct.pack(">I", 1), entry), media.full(b"stts", 0, struct.pack(">III", 1, n, 10)), media.full(b"stsc", 0, struct.pack(">IIII", 1, 1, n, 1)), stsz, media.full(b"stco", 0, struct.pack(">II", 1, offset)))
    mdia = media.box(b"mdia", mdhd, media.full(b"hdlr", 0, bytes(4), kind, bytes(12), b"x\0"), media.box(b"minf", media.box(b"stbl", *tables)))
    return media.box(b"trak", media.full(b"tkhd", 7, struct.pack(">IIIII", 0, 0, who, 0, 0), bytes(60)), mdia)


def test_media_of_several_tracks_and_fragments():
    long = media.box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, 90_000, 1 << 33, 0, 0))
    short = media.full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 1000, 30, 0, 0))
    sound = track_boxes(1, b"soun", b"mp4a", short, media.full(b"stz2", 0, struct.pack(">II", 4, 3), bytes([0x12, 0x30])), 5000, 3)
    video = track_boxes(2, b"vide", b"avc1", long, media.full(b"stsz", 0, struct.pack(">IIII", 0, 2, 100, 50)), 6000, 2)
    trex = media.box(b"mvex", media.full(b"trex", 0, struct.pack(">IIIII", 2, 1, 40, 7, 0x10000)))
    moov = media.box(b"moov", sound, video, trex)
    run = media.full(b"trun", 0x1 | 0x4 | 0x200, struct.pack(">IiI", 3, 64, 0), struct.pack(">III", 11, 12, 13))
    moof = media.box(b"moof", media.full(b"mfhd", 0, struct.pack(">I", 1)), media.box(b"traf", media.full(b"tfhd", 0x20000 | 0x8, struct.pack(">II", 2, 33)), run))
    own = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0x1, struct.pack(">IQ", 1, 9000)), media.full(b"trun", 0x1 | 0x100, struct.pack(">Iiii", 2, 4, 5, 6))))
    file = moov + moof + own
    first, second = media.tracks(file)
    assert (first.kind, first.codec, first.sizes[:3], first.offsets[:3]) == ("soun", "mp4a", [1, 2, 3], [5000, 5001, 5003]) and (first.timescale, first.width) == (1000, 0)
    assert first.offsets[3:] == [9004, 9004] and first.duration == 30 + 11
    assert (second.kind, second.timescale, second.width, second.sizes) == ("vide", 90_000, 320, [100, 50, 11, 12, 13])
    at = len(moov) + 64
    assert second.offsets == [6000, 6100, at, at + 11, at + 23] and second.keys == [0, 1, 2] and second.duration == 20 + 3 * 33
    assert media.demux(file).kind == "vide" and media.demux(media.box(b"moov", sound)).codec == "mp4a"
    with pytest.raises(ValueError):
        media.tracks(file[:-3])


def test_media_of_all_texts(spark):
    got = {(r["doc_id"], r["n_bytes"]): r["media"] for r in media.store(frame(spark, extra=True)).collect()}
    for i, t, *_ in documents():
        raw = (t or "").encode()
        file = bytes(got[(i, len(raw))])
        assert media.payload(file, media.demux(file)) == media.pad(raw)


# Sharding -----------------------------------------------------------------------------------------------------------


def plain_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_paper_and_moves_little():
    keys = np.concatenate([np.arange(5000), np.array([-1, -(2**63), 2**63 - 1])]).astype(np.int64).view(np.uint64)
    for n in (1, 2, 8, 9, 100):
        got = sharding.jump(keys, n)
        assert got.tolist() == [plain_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b]) == {8} and 0.08 < (a != b).mean() < 0.14


def test_slots_are_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 17)
    got = sharding.number(sharding.assign(frame(spark, extra=True), 4), ["doc_id", "text"]).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["grown_shard"] in (r["shard"], 4)
    assert sum(map(len, slots.values())) == len(documents()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.number(sharding.assign(frame(spark, []), 4), ["doc_id"]).count() == 0


# Decontamination -------------------------------------------------------------------------------------------------------


def brute_hits(docs, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = []
    for _, text, *_ in docs:
        w = find(text)
        hit, ids = [False] * len(w), set()
        for name, body in items:
            q = find(body)
            n = min(window, len(q))
            for k in range(len(q) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == q[k : k + n]:
                        hit[s : s + n] = [True] * n
                        ids.add("" if name is None else str(name))
        out.append((len(w), sum(hit), sorted(ids), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(8)
    items = [(i, prose(rng, "en", n)) for i, n in enumerate((40, 13, 12, 5, 2, 1, 0))] + [(7, None), (8, ""), (10, "Same words, twice"), (9, "same WORDS twice"), (None, "an item without id"), (11, "no " * 30), (12, "No " * 30), (13, "yes no " * 14), (14, "no yes no"), (14, "\U0001f600é no")]
    docs = [(100, "no " * 200, "en", "s", 0), (101, "yes " + "no " * 13 + "yes no yes no " * 6, "en", "s", 0), (102, "no " * 12 + "é " + "no " * 12, "en", "s", 0)]
    for i in range(40):
        text = prose(rng, "de", rng.choice((5, 60, 300)))
        body = items[i % 6][1].split()
        at = rng.randint(0, max(0, len(body) - 14))
        docs.append((i, f"{text} {' '.join(body[at:at + rng.choice((12, 13, 14, 40))]).upper()} {text}", "de", "s", 0))
    docs += [(90, "x same-words.twice y", "en", "s", 0), (91, "an item without id", "en", "s", 0)] + [r for r in documents() if len(r[1] or "") < 1500]
    got = decontam.scan(frame(spark, docs, extra=True), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = sorted(zip([str(d[0]) for d in docs], brute_hits(docs, items, 13)))
    assert sorted((str(r["doc_id"]), (r["n_words"], r["n_hit"], r["items"], r["contaminated"])) for r in got) == want
    if block_bytes > 300:  # words of equal hashes are told apart by their bytes
        hashing, words.hash_words = words.hash_words, lambda data, start, end, seed=0: hashing(data, start, end, seed) % np.uint64(50 if seed == 0 else 1 << 62)
        try:
            index = decontam.windows_of([("a", "one two three four"), *((str(i), f"word{i} and {i * i}") for i in range(60))], 3)
        finally:
            words.hash_words = hashing
        assert index.seed == 1
    none = decontam.scan(frame(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated OR n_hit > 0").count() == 0
    assert decontam.scan(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contamination_of_repetitive_texts():
    rng = random.Random(4)
    index = decontam.windows_of([(str(i), "no " * 400) for i in range(50)] + [("x", " ".join(rng.choice("ab") for _ in range(20_000)))], 13)
    decontam.file_windows(index, {k: np.ones(len(v), np.int64) for k, v in index.shingles.items()})
    assert sum(index.items[h] == [str(i) for i in range(50)] for h in index.holders.tolist()) == 1  # equal windows and items are kept once

    class Shared:
        value = ("repetitive", index)

    texts = ["no " * 1_000_000, " ".join(rng.choice("ab") for _ in range(100_000))]
    took = time.process_time()
    found = decontam.find_windows(Shared, pa.array(texts, pa.string())).to_pylist()
    assert time.process_time() - took < 30
    assert [f["n_words"] for f in found] == [1_000_000, 100_000] and found[0]["n_hit"] == 1_000_000 and len(found[0]["items"]) == 50
    assert 95_000 < found[1]["n_hit"] and found[1]["items"] == ["x"]


# Quality --------------------------------------------------------------------------------------------------------------------


def test_quality_of_unseen_texts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = prose(rng, ("en", "de", "es")[i % 3], rng.choice((20, 60, 150)))
        rows.append((i, text if good else rng.choice((" | ".join(text.split()), text.upper().replace(" ", "!! "), (text.split()[0] + " ") * 80)), "en", "s", 0))
        labels.append((i, int(good), 0))
    df = frame(spark, rows + [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "x" * 200_000, None, None, 0)], extra=True)
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(0, 400, 5)]
    assert sum((got[i]["score"] >= 0.5) == (i % 4 > 0) for i in held) >= 0.9 * len(held)
    one = quality.fit(df, lab.filter("quality = 1"))
    assert quality.score(df, one).filter("score = 1.0").count() == 403
    assert quality.score(frame(spark, []), quality.fit(frame(spark, []), lab.limit(0))).count() == 0


# Licences --------------------------------------------------------------------------------------------------------------------


def test_licence_spellings_and_copyright_lines(spark):
    known = dict(licenses.known_texts())
    mit = known["MIT"]
    texts = [mit, "Copyright (c) 2020 J. Someone\n\n" + mit.upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), mit.replace("software", "hardware"), "words\n  licensed under the apache LICENCE, version 2.0\nmore", None, "", "!!!", "© 2021 X"]
    texts += ["Copyright 2024 Acme Inc. All rights reserved.", "Copyright (c) 2024 X. Released under the MIT Licence.", "a\n\nCopyright 2024 Acme. All rights reserved.\r\n"]
    texts += [known["GPL-3.0"].replace("\n", "\n\t "), " ".join(known["Apache-2.0"].split()).lower(), known["Zlib"] + "one word more"]
    df = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)], extra=True)
    got = {r["doc_id"]: (r["license_id"], r["paragraph_license_ids"]) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT"] + [None] * 6 and got[3][1] == ["Apache-2.0"] and got[4][1] == []
    assert got[8] == ("LicenseRef-all-rights-reserved", ["LicenseRef-all-rights-reserved"]) and got[9] == ("MIT", ["MIT"]) and got[10] == (None, ["LicenseRef-all-rights-reserved"])
    assert [got[i][0] for i in (11, 12, 13)] == ["GPL-3.0", "Apache-2.0", None]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_every_known_text_is_found(spark):
    texts = licenses.known_texts()
    rows = [(i, "Copyright 1999 Some One\n" + body.upper(), None, None, 0) for i, (_, body) in enumerate(texts)]
    assert len(texts) > 25 and {r["doc_id"]: r["license_id"] for r in licenses.scan(frame(spark, rows)).collect()} == {i: name for i, (name, _) in enumerate(texts)}
    forms = [r.form for r in licenses.known(spark).collect()]
    words = licenses.anchors(forms)
    assert len(words) < 8 and all(any(w in form for w in words) for form in forms)
    assert licenses.scan(frame(spark, rows + [(-1, "a, b!", None, None, 0)]), licenses.known(spark, [("x", "A B")])).filter("license_id = 'x'").count() == 1


def test_documents_schema_is_that_of_the_tables():
    assert [f.split()[0] for f in DOCS.split(", ")] == ["doc_id", "text", "lang", "source", "n_chars"] and json
