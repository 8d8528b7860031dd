"""The registered text queries and the pipeline on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import DOCS
from tests.llm.test_text import brute_groups, brute_hits
from tidemark.llm import queries
from tidemark.llm.common import read_table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_sql(spark):
    import duckdb

    from verify import TABLES, rows_of

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        cur = db.execute(sql)
        columns = [c[0] for c in cur.description]
        assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall()), name


def test_rows_and_columns(spark):
    n = read_table(spark, DATA, "documents").count()
    for name, columns in {
        "op3_language_kneser_ney": "doc_id held_out lang_pred score",
        "op5_near_duplicates": "doc_id n_shingles component_id kept",
        "op6_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op7_jump_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op9_quality_compression": "doc_id held_out score predicted",
    }.items():
        df = queries.QUERIES[name](spark, DATA)
        assert set(columns.split()) <= set(df.columns) and df.count() == n, name
    assert queries.QUERIES["op1_html_main_text"](spark, DATA).filter("text = ''").count() == 0


def test_near_duplicates_and_contamination_by_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in queries.op5_near_duplicates(spark, DATA).collect()}
    assert got == {r[0]: g for r, g in zip(rows, brute_groups(rows))}
    items = [tuple(r) for r in read_table(spark, DATA, "benchmark").collect()][:6]
    short = [r for r in rows if len(r[1]) < 1200]
    from tidemark.llm import decontam

    found = decontam.scan(spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in found.collect()) == sorted((d[0], h[0], h[1], h[3]) for d, h in zip(short, brute_hits(short, items, 13)))


def _documents(spark) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in read_table(spark, DATA, "documents").select("doc_id", "text").collect()}


def test_packing_query_by_brute_force(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(str(queries.TOKENIZER)).encode
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op2_packing_first_fit(spark, DATA).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    docs = _documents(spark)
    assert pieces.keys() == docs.keys()
    total = 0
    for key, text in docs.items():
        ids = [*encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(own, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padded += at if at & (at - 1) == 0 else 1024
    assert padded <= 1.02 * total + 1024


def test_media_query_by_brute_force(spark):
    from tidemark.llm import media

    docs, rows = _documents(spark), queries.op6_media_columns(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file, n = media.mux(payload), len(payload) // 576
        at = len(file) - len(payload)
        keys = ",".join(f"{at + k * 576}-{at + k * 576 + 576}" for k in range(0, n, 12))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and file.endswith(payload)
        assert r["feature"] == f"codec=raw;size=24x24;duration_ms={n * 40};samples={n};keyframes={-(-n // 12)};ranges={keys}"


def test_sharding_query_by_brute_force(spark):
    def jump(key: int, shards: int) -> int:
        at, to = -1, 0
        while to < shards:
            at = to
            key = (key * 2862933555777941757 + 1) % 2**64
            to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
        return at

    docs, slots = _documents(spark), defaultdict(list)
    for r in queries.op7_jump_sharding(spark, DATA).collect():
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9)) and r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(docs) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_language_and_quality_of_held_out_rows(spark):
    """Held-out accuracy of the queries as registered; every row has one result."""
    rows = queries.op3_language_kneser_ney(spark, DATA).join(read_table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and sum(r["rejected"] for r in held) <= 0.02 * len(held)
    scored = queries.op9_quality_compression(spark, DATA).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_pipeline_stages(spark):
    docs = read_table(spark, DATA, "documents").withColumn("score", F.lit("own"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0.5 * before < docs.count() <= before and docs.filter("score <> 'own'").count() == 0
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_pipeline_of_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "words " * 400, "en", None, 3)]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, spark.createDataFrame(rows, DOCS), DATA).collect()
        stage(spark, spark.createDataFrame([], DOCS), DATA).collect()
