"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright statements,
equivalent spellings and white space no longer matter) and its SHA-256 is hash-joined
to the digests of known licence texts. Whole documents are looked up, and so is each of
their lines, since notices mostly stand on a line of their own. The canonical
form is taken once, line by line: that of the whole text is its lines' forms together.
All of it is built-in SQL functions.

Known texts are the files of `licence_texts` (whole licences, by SPDX identifier) and the
notices of KNOWN. Lines are exploded for texts only that hold an anchor: one of a few words of
which each known text has one, and which no spelling rule touches.

Defined cases: null and empty texts match nothing; a text of copyright statements only has no
digest; repeated rows are kept; an empty table gives no rows; other columns pass through (those
named like the added ones are replaced).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh

#: Known notices, by SPDX identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]

#: Spellings that count as equal, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("https://", "http://"),
    ("©", "(c)"),
]
#: Known texts up to which their digests are broadcast (about 100 bytes each), and hit texts likewise.
BROADCAST_ROWS = 200_000
#: A statement at the head of a line of who holds a copyright since when; what is granted after it stays. It has a
#: year, anywhere in the line, or the sign (lines that merely begin with the word, in wrapped prose or lists, are text).
GRANTS = "all rights reserved|licensed under|released under|distributed under|this work is|permission is"
COPYRIGHT = rf"^[ \t]*(?:copyright[ \t]+(?:\(c\)|[^\n]*?[0-9]{{4}})|\(c\)[ \t]*(?:copyright|[0-9]{{4}}))[^\n]*?({GRANTS}|$)"
#: All but line ends that isn't a letter, a digit or a sign beyond ASCII.
#: (A single space is left alone: it needs no replacement.)
SIGNS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]{2,}|[^a-z0-9 \n\x{80}-\x{10FFFF}]"


@lru_cache(1)
def known_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of all texts that come with the package."""
    folder = files(__package__) / "licence_texts"
    return KNOWN + sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines."""
    text = F.lower(text)
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(F.regexp_replace(text, "(?dm)" + COPYRIGHT, "$1"), SIGNS, " ")
    return F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))


def joined(lines: Column) -> Column:
    """The canonical form of a whole text."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digest(form: Column) -> Column:
    """Hex SHA-256 of a canonical form; null if that is empty."""
    return F.when(form != "", F.sha2(form, 256))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest and form of known licence texts, one row for each digest."""
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, body string")
    rows = rows.withColumn("form", joined(canonical_lines(F.col("body"))))
    return rows.groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.first("form").alias("form")).filter("digest is not null")


def anchors(forms: list[str]) -> list[str]:
    """Words, taken greedily, of which each form has one; none that a spelling rule may have written."""
    written = [w for _, new in SPELLINGS for w in re.findall("[a-z]+", new)]
    left = [{w for w in form.split() if len(w) > 4 and w.isascii() and w.isalpha() and not any(x in w for x in written if len(x) > 1)} for form in forms]
    if not all(left):
        return [""]  # a form without such a word: every text is looked at
    out = []
    while left:
        count = Counter(w for words in left for w in words)
        out.append(min(count, key=lambda w: (-count[w], w)))
        left = [words for words in left if out[-1] not in words]
    return out


def scan(docs: DataFrame, licences: DataFrame | None = None, text: str = "text") -> DataFrame:
    """docs with text_digest, license_id (of the whole text) and paragraph_license_ids (of its lines: sorted, distinct).
    licences: digest, license_id and form, like known() returns."""
    licences, path = cut(known(docs.sparkSession) if licences is None else licences, "licences")
    stats = licences.select(F.length("form").alias("n"), "form").collect()  # the list of known texts, which is what a user states
    few = len(stats) <= BROADCAST_ROWS
    names = licences.select("digest", "license_id")
    names = F.broadcast(names) if few else names
    # lines: only of texts that hold an anchor, only of a known length; texts are told apart by their digest
    held = F.lower(F.col(text))
    held = reduce(lambda a, b: a | b, [F.contains(held, F.lit(w)) for w in anchors([r.form for r in stats])], F.lit(False))
    lengths = F.array(*(F.lit(n) for n in sorted({r.n for r in stats}))).cast("array<int>")
    mark = F.sha2(F.col(text), 256)
    of, at = fresh(docs, "of", "mark")
    lines = docs.filter(held).select(mark.alias(of), F.explode(F.array_distinct(F.filter(canonical_lines(F.col(text)), lambda x: F.array_contains(lengths, F.length(x))))).alias("form"))
    hits = lines.withColumn("digest", F.sha2("form", 256)).join(names, "digest").groupBy(of).agg(F.array_sort(F.collect_set("license_id")).alias("paragraph_license_ids"))
    hits, _ = cut(hits, "licence-lines")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    own = docs.drop("license_id", "paragraph_license_ids").withColumns({"text_digest": digest(joined(canonical_lines(F.col(text)))), at: mark})
    own = own.join(names.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(hits, F.col(at) == F.col(of), "left")
    return own.withColumn("paragraph_license_ids", F.coalesce("paragraph_license_ids", F.array().cast("array<string>"))).drop(at, of)
