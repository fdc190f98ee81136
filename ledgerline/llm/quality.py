"""Compression classifier: zstandard dictionaries of good and of bad text, and a calibrated difference of compressed sizes.

Two raw-content dictionaries are cut from labelled training texts, in slices of many documents. A text is compressed once
with each. The normalised difference of the two sizes tells whose words it has; the size with the good dictionary over
the text's length tells repetition, which both dictionaries compress alike. A logistic curve over them and the length's
logarithm gives the calibrated score; it is fitted on training rows that no dictionary saw, weighted to the labels' own
shares. The fit reads at most 2 * SAMPLE rows per label, chosen by a hash of doc_id, and of a longer text SAMPLE_CHARS characters from a
place that the same hash gives: that is the bound of what reaches the driver, whatever the corpus holds. Scoring reads every whole text
and nothing else.

Empty and null texts are scored like any other, texts of any length whole; null, empty or unlabelled rows don't train; of several
labels of a doc_id the smallest counts; repeated rows are kept; extra columns are ignored; an empty table gives no rows. Without labels of both
kinds every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import texts

SAMPLE = 1_500
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 1 << 20
SLICE = 2_000
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def score(self, text: bytes) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features(self.good, self.bad, text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


@lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    def one(data: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False)

    return one(good), one(bad)


def features(good: bytes, bad: bytes, text: bytes) -> tuple[float, ...]:
    """The normalised difference of the compressed sizes (negative: closer to good text), the compressed share, and their products."""
    with_good, with_bad = (len(c.compress(text)) for c in _compressors(good, bad))
    x, share, length = (with_good - with_bad) / (with_good + with_bad), with_good / (len(text) + 1), math.log1p(len(text))
    return x, x * length, share, share * share, length, share * length


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 0 by 5: never trained on."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _dictionary(rows: list[bytes]) -> bytes:
    """Slices of all texts in turn, until the dictionary is full."""
    parts, size = [], 0
    for at in range(0, 4 * SAMPLE_CHARS, SLICE):
        for text in rows:
            if part := text[at : at + SLICE]:
                parts.append(part)
                size += len(part)
        if size >= DICTIONARY_BYTES:
            break
    return b"".join(parts)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method on standardised columns."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / std
    return np.append(beta[0] - (slopes * mean).sum(), slopes)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """The model of rows of `labels` (doc_id, quality) that aren't held out; None without both labels."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.filter(~held_out(F.col("doc_id"))).withColumn("_at", F.xxhash64("doc_id"))
    shares = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(shares) < 2:
        return None
    chosen = marked.filter("quality = 0").orderBy("_at", "doc_id").limit(2 * SAMPLE).union(marked.filter("quality = 1").orderBy("_at", "doc_id").limit(2 * SAMPLE))
    part = F.expr(f"substring(text, 1 + pmod(_at, greatest(1, length(text) - {SAMPLE_CHARS} + 1)), {SAMPLE_CHARS})")
    # At most 4 * SAMPLE rows of two numbers are broadcast.
    marked = texts(docs).filter("text != ''").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "_at", part.alias("text"))
    rows = marked.groupBy("doc_id", "quality", "_at").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["_at"], r["doc_id"]))
    by = {q: [r["text"].encode() for r in rows if r["quality"] == q] for q in (0, 1)}
    if min(map(len, by.values())) < 2:
        return None
    good, bad = (_dictionary(by[q][::2]) for q in (1, 0))
    x, y, w = [], [], []
    for q in (0, 1):
        rest = by[q][1::2]
        for text in rest:
            x.append(features(good, bad, text))
            y.append(q)
            w.append(shares[q] / len(rest) / sum(shares.values()) * SAMPLE)
    return QualityModel(good, bad, tuple(_logistic(np.array(x), np.array(y, float), np.array(w)).tolist()))


def scorer(spark: SparkSession, model: QualityModel | None) -> Callable[[Column], Column]:
    """A function from a text column to its score column."""
    if model is None:
        return lambda text: F.lit(0.5)
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    @F.pandas_udf("double")
    def scores(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in rows:
            yield pd.Series([m.score(t.encode()) for t in part], dtype=float)

    return lambda text: scores(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1: good)."""
    scored = texts(docs).withColumn("score", scorer(docs.sparkSession, fit(docs, labels))(F.col("text")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
