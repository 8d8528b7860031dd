"""The corpus pipeline: language, quality, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
The stages up to the last drop rows and return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, neardup, packing, quality
from tidemark.llm.common import cut, discard, doc_hash, fresh, read_table
from tidemark.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts in none of the languages that the labelled rows are in."""
    model = langid.fit(docs.filter(doc_hash() % 3 != 1))
    (found,) = fresh(docs, "language")
    return langid.identify(docs, model, into=found).filter(~F.col(found)["rejected"]).drop(found)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose score is under the threshold."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").filter(doc_hash() % 5 != 0))
    score, kept = fresh(docs, "score", "good")
    return quality.score(docs, model, names=(score, kept)).filter(F.col(kept) == 1).drop(score, kept)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each group of near-duplicates, linked from a similarity of 0.8 on; 44 bands miss about 2e-6 of the pairs there."""
    return neardup.dedup(docs, percent=80, bands=44)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold passages of the benchmark."""
    (found,) = fresh(docs, "found")
    return decontam.scan(docs, read_table(spark, sf_dir, "benchmark"), into=found).filter(~F.col(found)["contaminated"]).drop(found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts left, by sequence."""
    return packing.pack(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("quality", good), ("near_duplicates", single), ("decontamination", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again, and goes once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = cut(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return docs


#: Models, iteration and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
