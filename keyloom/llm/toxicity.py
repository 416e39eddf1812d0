"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, its words' beginnings, adjacent pairs, pairs with one word between, and triples, each
hashed and counted once. Every coordinate has its own learning rate, and the L1 term keeps most weights at zero, so the
model is a short list of (index, weight) that is broadcast. It is fitted in one task on a bounded sample of the labelled
rows (``max_fit`` documents, those with the smallest hashes of their ids); scoring reads all rows.

Defined results: a null or wordless text has the score of the bias alone; rows with a null id or null label are not
learned from; without any row to learn from every score is 0.5; repeated labels count as often as they come; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, crc_mod, documents, slices, struct, text_udf, whole_rows, with_fields

BUCKETS = 1 << 22
#: Labelled documents that the model is fitted on, at most.
MAX_FIT = 12_000
THRESHOLD = 0.7
EPOCHS = 4
#: FTRL-proximal: rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
#: Bytes of a word's beginnings.
STEMS = (5, 6, 8)


def features(text: bytes) -> np.ndarray:
    """The sorted distinct feature indexes of a text."""
    words = text.translate(LETTERS).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    stems = np.fromiter((zlib.crc32(w[:n]) + n for w in set(words) for n in STEMS if len(w) > n), np.uint64)
    mix = lambda x, salt: (x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x0165667B19E3779F)) >> np.uint64(20)
    pair = lambda a, b, salt: mix(a * np.uint64(0x100000001B3) ^ (b << np.uint64(7)), salt)
    parts = [mix(h, 1), mix(stems, 2), pair(h[:-1], h[1:], 3), pair(h[:-2], h[2:], 4)]
    if len(h) > 2:
        parts.append(pair(pair(h[:-2], h[1:-1], 5), h[2:], 6))
    return np.unique((np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64))


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; weights are derived from (z, n)."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) in order -> one row (bias, index array, weight array)."""
    rows: list[tuple[np.ndarray, int]] = []
    for b in batches:
        labels = iter(b.column(1).to_pylist())
        rows += [(features(t).astype(np.int32), next(labels)) for texts in slices(b.column(0)) for t in texts]
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, y in rows:
            model.learn(at, y)
    touched = np.flatnonzero(model.n)
    w = model.weights(touched)
    kept = w != 0
    arrays = [pa.array([model.bias]), pa.array([touched[kept].astype(np.int64)]), pa.array([w[kept]])]
    yield pa.RecordBatch.from_arrays(arrays, names=["bias", "at", "w"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_fit: int = MAX_FIT) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, indexes, weights) of ``docs(doc_id, text)`` under ``labels(doc_id, label)``."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("y")).where("__id IS NOT NULL AND y IS NOT NULL")
    # max_fit bounds the side that is broadcast.
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "y").limit(max_fit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # An id may come in any number of documents, so the joined rows are bounded as well.
    ordered = rows.select("text", "y", F.xxhash64("__id").alias("h"), "__id", F.xxhash64("text").alias("t")).orderBy("h", "__id", "y", "t").limit(max_fit)
    got = ordered.select("text", "y").coalesce(1).mapInArrow(fit_rows, "bias double, at array<long>, w array<double>").first()
    if got is None:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    return got.bias, np.array(got.at, np.int64), np.array(got.w)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and score, the probability of the label, for every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.int32), model[2].astype(np.float32)))

    def make():
        bias, at, w = shared.value
        table = np.zeros(BUCKETS, np.float32)
        table[at] = w

        def kernel(texts: list[bytes]) -> list:
            sums = np.array([table[features(t)].sum(dtype=np.float64) + bias for t in texts])
            return [1 / (1 + np.exp(-np.clip(sums, -700, 700)))]

        return kernel

    return with_fields(docs, list(keep), text_udf(make, struct(score=T.DoubleType()))(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, all columns kept."""
    scored = score(docs.select(whole_rows(), F.col(text_col).alias("__text")), model, text_col="__text", keep=("__doc",))
    return scored.where(F.col("score") < threshold).select("__doc.*")


def training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents and the labels that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    return documents(spark, sf_dir), labels


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir), fit(*training(spark, sf_dir)))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
