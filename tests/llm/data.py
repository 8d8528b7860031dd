"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

SOUNDS = {"en": "the and tion ing er of th wh ou ly".split(), "de": "der ung sch ein keit ü ö ver zu ß".split(), "es": "ción que ar los ña do mente rr ez ó".split()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = []
    for _ in range(words):
        out.append("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(("", "", "", ",", ".")))
    return " ".join(out)


def edit(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    rng, texts = random.Random(seed), []
    for i in range(n):
        lang = ("en", "de", "es")[i % 3]
        texts.append((prose(rng, lang, rng.choice((3, 20, 60, 200))), lang))
    for i in range(20):  # near copies, some of them chained
        base, lang = texts[3 * i + 2]
        texts.append((edit(rng, base, 1), lang))
        texts.append((edit(rng, texts[-1][0], 2), lang))
    texts += [texts[0], texts[0], (prose(rng, "en", 30_000), "en"), (None, "en"), ("", "de"), (" \n\t ", None), ("12 34 !!", None), ("one two", "en"), ("ONE two", "en"), ("éß 中文 \U0001f600 <|endoftext|> </s>", None), ("a" * 5000, "en"), ("!!! " * 50, None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return rows + [rows[0], (None, "no id here at all, none whatsoever", "en", None, 1)]


def frame(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    if extra:  # columns named like those that operators add
        for name in ("score", "predicted", "entropy", "rejected", "lang_pred", "n_words", "n_hit", "items", "contaminated", "key", "th", "node", "size", "shard", "slot", "kept", "license_id", "text_digest", "media", "start", "length"):
            df = df.selectExpr("*", f"'own' AS {name}")
    return df.repartition(3)
