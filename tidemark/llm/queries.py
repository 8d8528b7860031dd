"""The registered queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontam, html_extract, langid, licenses, media, neardup, packing, quality, search, sharding, trie
from tidemark.llm.common import cut, discard, doc_hash, read_table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op2_packing_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), str(TOKENIZER))


def op3_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = doc_hash() % 3 == 1
    model = langid.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.expand(rows))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _media_digests(batches):
    for batch in batches:
        keys, sizes, files = batch.columns
        out = {"doc_id": keys, "n_bytes": sizes, "payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "media_bytes": [], "media_sha256": [], "feature": []}
        for file in files:
            data = file.as_buffer().to_pybytes()
            track = media.demux(data)
            read = media.payload(data, track)
            for name, value in (("payload_bytes", len(read)), ("payload_sha256", hashlib.sha256(read).hexdigest()), ("tail_crc32", zlib.crc32(read[-32:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", track.feature())):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(read_table(spark, sf_dir, "documents"))
    return stored.mapInArrow(_media_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.assign(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    rows = docs.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return sharding.number(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = doc_hash() % 5 == 0
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "license_id", F.array_join("paragraph_license_ids", ",").alias("paragraph_licenses"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=50)


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(spark, str(RANKS), public_tokenizers.PATTERN)
    coded = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = bpe.decode(coded.select("doc_id", "ids"), vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, first = trie.turns_of(read_table(spark, sf_dir, "conversations"))
    turns, members = trie.regrouped(placed)
    turns, second = cut(turns, "trie-regrouped")
    found = trie.build(turns, members)
    for path in (first, second):
        discard(spark, path)
    own = found.nodes.join(trie.ends_digest(found.ends), ["conv_id", "depth"], "left")
    none = F.sha2(F.lit(""), 256)
    return own.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_packing_first_fit": op2_packing_first_fit,
    "op3_language_kneser_ney": op3_language_kneser_ney,
    "op4_chat_prefix_targets": op4_chat_prefix_targets,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_media_columns": op6_media_columns,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality_compression": op9_quality_compression,
    "op10_license_digests": op10_license_digests,
    "op11_ranked_search": op11_ranked_search,
    "op12_byte_level_bpe": op12_byte_level_bpe,
    "op13_conversation_trie": op13_conversation_trie,
}

_CONTROLS = r"[\\<|\[]"
_ORACLE4 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(role) + len(regexp_extract_all(role, '{_CONTROLS}')) + length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + 13) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars,
  (count(*) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS n_examples
FROM sized GROUP BY conv_id
"""


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    form = f"lower({column})"
    for old, new in licenses.SPELLINGS:
        form = f"replace({form}, {_sql_text(old)}, {_sql_text(new)})"
    form = f"regexp_replace(regexp_replace({form}, {_sql_text('(?m)' + licenses.COPYRIGHT)}, '\\1', 'g'), {_sql_text(licenses.SIGNS)}, ' ', 'g')"
    return f"list_transform(string_split({form}, chr(10)), lambda x: trim(x))"


_ORACLE10 = f"""
WITH known AS (
  SELECT sha256(array_to_string(list_filter({_sql_lines("body")}, lambda x: x <> ''), ' ')) AS digest, min(license_id) AS license_id
  FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in licenses.known_texts())}) AS t(license_id, body) GROUP BY 1),
forms AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
texts AS (SELECT doc_id, lines, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS form FROM forms),
found AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, unnest(lines) AS line FROM forms) JOIN known ON known.digest = sha256(line) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS text_digest, k.license_id, coalesce(ids, '') AS paragraph_licenses
FROM texts t LEFT JOIN known k ON k.digest = CASE WHEN form <> '' THEN sha256(form) END LEFT JOIN found USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLE5 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1),
named AS (SELECT c.s, l.c FROM classes c JOIN least l USING (id))
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(named.c, sets.doc_id) AS component_id, sets.doc_id = coalesce(named.c, sets.doc_id) AS kept
FROM sets LEFT JOIN named ON named.s = list_sort(sets.s)
"""

_ORACLE8 = rf"""
WITH rows AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT item_id, w, least({decontam.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM spans, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) t),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM rows, (SELECT DISTINCT n FROM windows) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) t),
found AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON v.n = p.n AND v.x = p.x),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found) f, LATERAL (SELECT unnest(range(i, i + n)) AS k) t GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT r.doc_id, len(r.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(r.w) AS contaminated
FROM rows r LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ORACLE11 = f"""
WITH own AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
docs AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM own WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS term FROM benchmark),
tfs AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM own) JOIN (SELECT DISTINCT term FROM asked) USING (term) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, n_docs),
impacts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM tfs JOIN docs USING (row) JOIN weights USING (term), totals),
scores AS (SELECT item_id, row, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, row, doc_id),
places AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM places WHERE rank <= 50
"""

_BITS = "list_reduce(list_prepend({0}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: {_BITS.format('xor(c, b)')}))"
_ORACLE13 = rf"""
WITH rows AS (SELECT conv_id, turn, length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS said, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, sha256(said) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(said)) AS i FROM rows),
convs AS (SELECT conv_id, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM placed)),
heads AS (SELECT c.conv_id, p.i AS depth, p.k, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.i <= c.h),
got AS (SELECT c.conv_id, c.h, count(h.depth) AS got FROM convs c LEFT JOIN heads h USING (conv_id) GROUP BY c.conv_id, c.h),
turns AS (SELECT * FROM heads UNION ALL SELECT p.conv_id, got + p.i - h, k, words FROM placed p JOIN got USING (conv_id) WHERE p.i > h),
paths AS (
  SELECT conv_id, depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, depth = count(*) OVER (PARTITION BY conv_id) AS last FROM turns
  UNION ALL SELECT conv_id, 0, 0, '', got = 0 AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = got.conv_id) FROM got),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM paths GROUP BY depth, path),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
subtrees AS (
  SELECT left(path, 64 * up) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT path, n_children, n_convs, words, unnest(range(0, depth + 1)) AS up FROM whole) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM whole n JOIN subtrees USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
"""

ORACLE_SQL = {"op13_conversation_trie": _ORACLE13, "op11_ranked_search": _ORACLE11, "op5_near_duplicates": _ORACLE5, "op8_decontamination": _ORACLE8, "op4_chat_prefix_targets": _ORACLE4, "op10_license_digests": _ORACLE10}
