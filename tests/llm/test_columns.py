"""Columns of the input that are named like those an operator uses in passing, and other cases that once failed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import frame, prose
from tidemark.llm import decontam, html_extract, langid, licenses, media, neardup, queries, sharding
from tidemark.llm.common import fresh

PASSING = ("_k", "_t", "_n", "_of", "_MARK", "_range", "_at", "_base", "_state", "_digest", "_own", "_found", "_language", "_score", "_good", "_y", "_d", "_part")


def named(df):
    return df.selectExpr("*", *(f"'own' AS `{x}`" for x in PASSING))


def same(df):
    rows = df.select(*PASSING).distinct().collect()
    assert [set(r) for r in rows] == [{"own"}]


def test_fresh_names_ignore_case(spark):
    assert fresh(named(spark.range(1)), "k", "mark", "new", "new") == ["_k0", "_mark0", "_new", "_new0"]


def test_no_column_is_lost_or_ambiguous(spark):
    docs = named(frame(spark))
    items = spark.createDataFrame([(1, prose(random.Random(1), "en", 30))], "item_id long, text string")
    same(neardup.dedup(docs))
    same(licenses.scan(docs))
    same(sharding.number(sharding.assign(docs, 4), ["doc_id"]))
    for size in (4 << 20, 100):
        same(decontam.scan(docs, items, block_bytes=size))
        same(decontam.scan(docs, items, block_bytes=size, into="_x"))
    same(langid.identify(docs, langid.fit(docs)))


def test_no_column_is_lost_in_the_pipeline(spark, tmp_path):
    labels = [(i, int(i % 4 > 0), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = named(frame(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        same(out)


def test_kept_is_that_of_the_least_id_when_ids_repeat(spark, tmp_path):
    text = prose(random.Random(3), "en", 120)
    rows = [(1, text, None, None, 0), (1, f"{text} more", None, None, 0), (2, f"{text} and more", None, None, 0), (2, "", None, None, 0), (3, None, None, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in queries.op5_near_duplicates(spark, str(tmp_path)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True)]


def test_hidden_elements_of_any_number(spark):
    trees = html_extract.stored()
    body = "".join(f"<p>Words number {i} of this text, long enough to be read as such.</p>" for i in range(6))
    for head in ("<svg>" + "<audio>" * 10 + "</svg>", "<canvas>" * 200 + "</canvas>" * 200, "<svg><audio><video></audio></svg>", "<video><audio></video></audio>"):
        assert "number 5" in html_extract.main_texts([f"<article>{head}{body}</article>"], trees)[0], head[:40]
    assert "number" not in html_extract.main_texts([f"<article><svg>{body}</article>"], trees)[0]


def test_a_year_anywhere_makes_a_copyright_line(spark):
    mit = dict(licenses.known_texts())["MIT"]
    far = "Copyright " + "some one and others, " * 30 + "since 1999, all of them\n"
    none = "Copyright " + "some one and others, " * 30 + "\n"
    df = frame(spark, [(1, far + mit, None, None, 0), (2, none + mit, None, None, 0)])
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(df).collect()} == {1: "MIT", 2: None}


def test_deeply_nested_boxes_are_an_error():
    file = media.mux(media.pad(b"x"))
    for _ in range(5000):
        file = media.box(b"moov", file) if len(file) < 1 << 20 else file
    with pytest.raises(ValueError):
        media.demux(file)


def test_long_texts_are_stored_one_by_one(spark):
    texts = ["é" * 700_000, None, "", "b" * 2_000_000, *("short " * k for k in range(300))]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = media.store(frame(spark, rows)).select("doc_id", "n_bytes", F.length("media").alias("n")).collect()
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {i: len((t or "").encode()) for i, t in enumerate(texts)} and all(r["n"] > r["n_bytes"] for r in got)

