"""From texts to predicted costs: the feature frame, speed models, sums by text, layouts compared."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import syllables
from . import features as feat
from .models import costs, ensemble, per_key
from .sequences import characters
from .windows import to_vector


class SpeedModel(ABC):
    """Predicts the interval before a key from the features around it."""

    features: list[str]
    back: int = 3
    ahead: int = 1

    @abstractmethod
    def predict(self, vector: str) -> tuple[Column, Column]:
        """(mean, deviation over the folds) as expressions of an array column."""

    def score(self, df: DataFrame, sequence: str, order: str = "pos") -> DataFrame:
        """pred_mean and pred_std of every key of a feature frame."""
        framed = to_vector(df, self.features, sequence, order, self.back, self.ahead, "__window")
        mean, std = self.predict("__window")
        return framed.withColumn("pred_mean", mean).withColumn("pred_std", std).drop("__window")


@dataclass
class LinearModel(SpeedModel):
    """An ensemble of linear models, one a fold."""

    features: list[str]
    folds: list[tuple[list[float], float]]
    back: int = 3
    ahead: int = 1

    def predict(self, vector: str) -> tuple[Column, Column]:
        return ensemble(vector, self.folds)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w, b, json.dumps({"features": self.features, "back": self.back, "ahead": self.ahead})) for i, (w, b) in enumerate(self.folds)]
        spark.createDataFrame(rows, "fold int, weights array<double>, bias double, spec string").coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str, n_folds: int = 10) -> LinearModel:
    """The first folds of a saved ensemble; an error if there is none."""
    rows = spark.read.schema("fold int, weights array<double>, bias double, spec string").json(path).orderBy("fold").limit(n_folds).collect()
    if not rows:
        raise FileNotFoundError(f"no fold of a model in {path}")
    spec = json.loads(rows[0].spec)
    return LinearModel(spec["features"], [(list(r.weights), r.bias) for r in rows], spec["back"], spec["ahead"])


def linguistic_features(rows: DataFrame, key: str, *, unigrams: DataFrame | None = None, bigrams: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Rows (key, pos, key, key_id) with the features that no layout changes: places in sequence, word and syllable, frequencies."""
    rows = feat.sequence_position(rows, key)
    if words is not None:
        rows = feat.word_frequency(rows, key, words)
    rows = syllables.positions(feat.word_position(feat.word_runs(rows, key), key), key).drop("run", "is_delim")
    if unigrams is not None:
        rows = feat.lookup(rows, unigrams.select(F.col("gram").alias("key"), F.col("zipf").alias("unigram_frequency")), ["key"], "unigram_frequency")
    if bigrams is not None:
        rows = rows.withColumn("__g", F.concat(F.lag("key").over(Window.partitionBy(key).orderBy("pos")), "key"))
        rows = feat.lookup(rows, bigrams.select(F.col("gram").alias("__g"), F.col("zipf").alias("bigram_frequency")), ["__g"], "bigram_frequency").drop("__g")
    return rows


def linguistic_frame(df: DataFrame, text: str, key: str, **tables: DataFrame) -> DataFrame:
    """``linguistic_features`` of every character of each text; made once, used for every layout."""
    return linguistic_features(characters(df, text, key), key, **tables)


def with_layout(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The features of a layout (``features.pair_table``) added to a linguistic frame."""
    w = Window.partitionBy(key).orderBy("pos")
    before = lambda n: F.coalesce(F.lag("key_id", n).over(w), F.lit(0))
    rows = rows.select("*", (before(1) * 128 + F.col("key_id")).alias("pair"), (before(2) * 128 + before(1)).alias("p_pair"))
    enriched = feat.from_pairs(rows.drop("key_id"), pairs, *[c for c in rows.columns if c not in ("key_id", "pair", "p_pair")])
    return enriched.select("*", (F.col("key_id") == 0).cast("double").alias("is_pad"), *(c for n, m in (("finger", 10), ("finger_type", 5), ("hand", 3)) for c in feat.one_hot(n, m)))


def predict_texts(df: DataFrame, key: str, length: str, rows: DataFrame, model: SpeedModel, pairs: DataFrame) -> DataFrame:
    """(key, cost, std, mean_z, std_z) of each text under a layout; ``rows`` is its linguistic frame."""
    scored = model.score(with_layout(rows, key, pairs), key)
    return per_key(costs(scored, df, key, "pred_mean", "pred_std").join(df.select(key, length), key), length)


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, diff): what the same texts cost more in the first of two results, by key pressed."""
    return a.select(key, F.col("mean_z").alias("__a")).join(b.select(key, F.col("mean_z").alias("__b")), key).select(key, (F.col("__a") - F.col("__b")).alias("diff"))


def strip_savings(strips: DataFrame, key: str, left: int, score) -> DataFrame:
    """(key, saving, word_std, abbr_std) of context strips; ``score`` gives pred_mean and pred_std of the characters of (key, text).

    Only the word's own part of a strip counts, as the context differs between word and abbreviation.
    """
    sides = []
    for side in ("word", "abbr"):
        texts = strips.select(key, F.col(f"{side}_ks").alias("text"), F.col(f"{side}_len").alias("n"))
        keys = score(texts).join(texts.select(key, "n"), key)
        cost = costs(keys, texts, key, "pred_mean", "pred_std", first=max(1, left), last=F.lit(left) + F.col("n"))
        sides.append(cost.select(key, F.col("cost").alias(f"{side}_cost"), F.col("std").alias(f"{side}_std")))
    both = sides[0].join(sides[1], key)
    return both.select(key, (F.col("word_cost") - F.col("abbr_cost")).alias("saving"), "word_std", "abbr_std")
