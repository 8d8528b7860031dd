"""A quality classifier made of two zstandard dictionaries.

One dictionary is trained on labelled good texts, one on bad texts. A text is
compressed with either, piece by piece, so that every piece is priced by what the
dictionaries know and not by what the text said before. The difference of the
two sums of compressed sizes, divided by the text's length, goes through a logistic
curve of one term, which is fitted on labelled texts that no dictionary saw.

The fit reads a bounded sample of labelled rows (`rows_a_class`, chosen by a hash of
the id), of each of its texts at most `pieces_a_text` pieces spread evenly, and at most
`dictionary_text` bytes for a dictionary, in the order of another hash of the id: the order of
files doesn't matter. Scoring compresses whole texts and keeps nothing but the model.

Defined cases: null and empty texts are scored like any other (their length is 0);
without labels of both classes every score is the share of good labels (0.5
without any); repeated rows are scored alike; an empty table gives no rows; other
columns pass through (score and predicted are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, made, sampled, share, trim

#: Score from which a text counts as good.
THRESHOLD = 0.3


#: Bytes of a piece that is compressed, and of one that a dictionary is trained on.
PIECE, SAMPLE = 512, 256


@dataclass
class Model:
    good: bytes
    bad: bytes
    level: int
    curve: tuple[float, float] | None  # constant and slope of the log-odds
    prior: float


class Compressors:
    def __init__(self, model: Model) -> None:
        def own(raw: bytes) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=model.level)
            return zstandard.ZstdCompressor(level=model.level, dict_data=dictionary, write_checksum=False, write_dict_id=False, write_content_size=False)

        self.model, self.good, self.bad = model, own(model.good), own(model.bad)

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Per text: how many bytes fewer the good dictionary leaves than the bad one, a byte of text."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            fewer = 0
            for at in range(0, max(1, len(raw)), PIECE):
                piece = raw[at : at + PIECE]
                fewer += len(self.bad.compress(piece)) - len(self.good.compress(piece))
            out[i] = fewer / (len(raw) + 16)
        trim()
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; x has the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(model: Model, difference: np.ndarray) -> np.ndarray:
    if model.curve is None:
        return np.full(len(difference), model.prior)
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * difference, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows_a_class: int = 4000, pieces_a_text: int = 256, dictionary_size: int = 112_640, dictionary_text: int = 16 << 20, level: int = 3, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Model from docs (key, text) and labels (key, label 0 or 1)."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values())) if n else 0.5
    none = Model(b"", b"", level, None, prior)
    if len(n) < 2:
        return none
    part = F.when(F.col("_y") == 1, min(1.0, rows_a_class / n[1])).otherwise(min(1.0, rows_a_class / n[0]))
    # the sample's size is bounded by rows_a_class, so it can go to every executor
    chosen, path = cut(docs.select(key, text).join(F.broadcast(known.filter(sampled(key, part, 9))), key).withColumn("_part", F.pmod(F.xxhash64(F.col(key), F.lit(91)), F.lit(4))), "quality")

    @F.arrow_udf("array<binary>")
    def spread(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            raw = x.as_buffer().to_pybytes() if x.is_valid else b""
            count = -(-len(raw) // SAMPLE)
            out.append([raw[SAMPLE * i : SAMPLE * i + SAMPLE] for i in (range(count) if count <= pieces_a_text else np.linspace(0, count - 1, pieces_a_text, dtype=int).tolist())])
        return pa.array(out, pa.list_(pa.binary()))

    raw = []
    for y in (1, 0):
        found, size = [], 0
        for r in chosen.filter(f"_y = {y} AND _part > 0").orderBy(F.xxhash64(F.col(key), F.lit(92)), key, F.xxhash64(text)).select(spread(F.col(text)).alias("p")).toLocalIterator():
            found += (bytes(p) for p in r["p"])
            size += sum(map(len, r["p"]))
            if size > dictionary_text:
                break
        try:
            raw.append(zstandard.train_dictionary(dictionary_size, found).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few texts to train on: they are the dictionary
            raw.append(b"\n".join(found)[-dictionary_size:] or b"\n" * 8)
    shared = share(spark, Model(raw[0], raw[1], level, None, prior))

    @F.arrow_udf("double")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(made(shared, Compressors).differences(texts))

    rows = chosen.filter("_part = 0").select("_y", measured(F.col(text)).alias("_d")).collect()
    discard(spark, path)
    y, x = np.array([r["_y"] for r in rows], float), np.array([r["_d"] for r in rows], float)
    if len(set(y)) < 2:
        return none
    mean, scale = x.mean(), x.std() + 1e-9
    # the sample holds classes in other shares than the labels do: weigh them back through the constant
    w = logistic(np.stack([np.ones(len(x)), (x - mean) / scale], 1), y)
    w[0] += np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(raw[0], raw[1], level, (float(w[0] - w[1] * mean / scale), float(w[1] / scale)), prior)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score (0 to 1, higher: better) and whether it reaches the threshold (1 or 0), under the given names."""
    if model.curve is None:
        return docs.withColumns({names[0]: F.lit(model.prior), names[1]: F.lit(int(model.prior >= threshold))})
    shared = share(docs.sparkSession, model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        with_ = made(shared, Compressors)
        return pa.array(probability(with_.model, with_.differences(texts)))

    return docs.withColumn(names[0], of(F.col(text))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
