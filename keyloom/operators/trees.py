"""Tree ensembles from files: the text format of gradient boosting models, predictions, and exact Shapley values.

A model file is a header of ``name=value`` lines and a block of such lines for each tree, in which lists hold a value for
each inner node or leaf; children below 0 are leaves, ~child their number. Ensembles over folds are directories of files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .inference import SpeedModel

# Fixed values of the format: bits of a node's decision, and how missing values are marked (bits 2 and 3).
CATEGORICAL, DEFAULT_LEFT = 1, 2
MISSING_ZERO, MISSING_NAN = 1, 2
#: Values nearer to 0 than this are 0 where 0 means missing.
ZERO = 1e-35


@dataclass
class Tree:
    """One tree; inner node i sends a row to left[i] or right[i], and ~i is leaf i."""

    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    leaf_rows: np.ndarray
    categories: list[frozenset[int]] = field(default_factory=list)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        """Whether values of the node's feature go to its left child."""
        kind = int(self.decision[node])
        if kind & CATEGORICAL:
            known = self.categories[int(self.threshold[node])]
            return np.array([v == v and v >= 0 and int(v) in known for v in x], bool)
        missing = kind >> 2 & 3
        lost = np.isnan(x)
        if missing != MISSING_NAN:
            x = np.where(lost, 0.0, x)
            lost = np.abs(x) <= ZERO if missing == MISSING_ZERO else np.zeros(len(x), bool)
        with np.errstate(invalid="ignore"):
            return np.where(lost, bool(kind & DEFAULT_LEFT), x <= self.threshold[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0 if len(self.feature) else ~0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = self.value[~node]
            elif len(rows):
                left = self.goes_left(node, x[rows, self.feature[node]])
                todo += [(int(self.left[node]), rows[left]), (int(self.right[node]), rows[~left])]
        return out

    def rows(self, node: int) -> float:
        """How many training rows reached a node."""
        return float(self.leaf_rows[~node]) if node < 0 else self.rows(int(self.left[node])) + self.rows(int(self.right[node]))

    def shapley(self, x: np.ndarray, n_features: int) -> np.ndarray:
        """Exact Shapley values of one row, an absent feature leaving a row to both children by their training rows.

        Along a path to a leaf every feature has the share with which rows without it get through, and whether the row itself
        does. The leaf's value counts for a set of features with the product over the path, so its Shapley values are sums
        over set sizes of a polynomial in these two numbers.
        """
        out = np.zeros(n_features)

        def leaf(value: float, path: dict[int, tuple[float, float]]) -> None:
            names = list(path)
            for name in names:
                # Coefficient k: products over the other features with k of them present.
                poly = np.ones(1)
                for other in names:
                    if other != name:
                        absent, present = path[other]
                        poly = np.append(poly, 0.0) * absent + np.append(0.0, poly) * present
                m = len(names)
                weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
                absent, present = path[name]
                out[name] += value * (present - absent) * float(poly @ weights)

        def walk(node: int, path: dict[int, tuple[float, float]]) -> None:
            if node < 0:
                leaf(float(self.value[~node]), path)
                return
            name = int(self.feature[node])
            absent, present = path.get(name, (1.0, 1.0))
            left = bool(self.goes_left(node, x[[name]])[0])
            total = self.rows(node)
            for child, taken in ((int(self.left[node]), left), (int(self.right[node]), not left)):
                walk(child, path | {name: (absent * (self.rows(child) / total if total else 0.5), present * taken)})

        if len(self.feature):
            walk(0, {})
        return out


def parse(text: str) -> tuple[list[str], list[Tree]]:
    """(feature names, trees) of a model file."""
    head, *blocks = text.split("\nTree=")
    fields = lambda block: dict(line.split("=", 1) for line in block.splitlines() if "=" in line)
    names = fields(head).get("feature_names", "").split()
    if not blocks or not names:
        raise ValueError("not a tree model: feature_names or trees are missing")
    trees = []
    for block in blocks:
        f = fields(block.split("\nend of trees")[0])
        row = lambda name, kind, f=f: np.array([kind(v) for v in f.get(name, "").split()])
        values = row("leaf_value", float)
        bounds, words = row("cat_boundaries", int), row("cat_threshold", int)
        categories = [
            frozenset(32 * i + bit for i, w in enumerate(words[lo:hi]) for bit in range(32) if int(w) >> bit & 1) for lo, hi in zip(bounds, bounds[1:], strict=False)
        ]
        counts = row("leaf_count", float)
        trees.append(Tree(
            row("split_feature", int), row("threshold", float), row("decision_type", int), row("left_child", int), row("right_child", int), values,
            counts if len(counts) else np.ones(len(values)), categories,
        ))
    return names, trees


@dataclass
class TreeModel(SpeedModel):
    """An ensemble over folds of tree models on the flattened window, rows missing a feature getting its pad."""

    features: list[str]
    folds: list[list[Tree]]
    back: int = 3
    ahead: int = 1

    def predict(self, vector: str) -> tuple[Column, Column]:
        folds = self.folds

        @F.pandas_udf("mean double, std double")
        def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for v in batches:
                x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
                guesses = np.array([sum(t.predict(x) for t in fold) for fold in folds])
                yield pd.DataFrame({"mean": guesses.mean(axis=0), "std": guesses.std(axis=0)})

        both = guess(F.col(vector))
        return both["mean"], both["std"]


def load_trees(spark: SparkSession, path: str, back: int = 3, ahead: int = 1, n_folds: int = 10) -> TreeModel:
    """The first folds, by file name, of an ensemble; names of the window's columns are ``feature_step`` or the bare features."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy("file").limit(n_folds).collect()
    if not files:
        raise FileNotFoundError(f"no fold of a model in {path}")
    parsed = [parse(f.value) for f in files]
    names = parsed[0][0]
    per_step = len(names) // (back + ahead + 1)
    return TreeModel([n.rsplit("__", 1)[0] for n in names[:per_step]], [trees for _, trees in parsed], back, ahead)


@dataclass
class NetworkModel(SpeedModel):
    """An ensemble over folds of networks with rectified hidden layers; a fold is a list of (weights, biases)."""

    features: list[str]
    folds: list[list[tuple[np.ndarray, np.ndarray]]]
    back: int = 3
    ahead: int = 1

    def predict(self, vector: str) -> tuple[Column, Column]:
        folds = self.folds

        @F.pandas_udf("mean double, std double")
        def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            from .models import network

            for v in batches:
                x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
                guesses = np.array([network(fold, x) for fold in folds])
                yield pd.DataFrame({"mean": guesses.mean(axis=0), "std": guesses.std(axis=0)})

        both = guess(F.col(vector))
        return both["mean"], both["std"]

    def save(self, spark: SparkSession, path: str) -> None:
        spec = json.dumps({"features": self.features, "back": self.back, "ahead": self.ahead})
        rows = [(i, [w.tolist() for w, _ in fold], [np.atleast_1d(b).tolist() for _, b in fold], spec) for i, fold in enumerate(self.folds)]
        spark.createDataFrame(rows, _NETWORK).coalesce(1).write.mode("overwrite").json(path)


_NETWORK = "fold int, weights array<array<array<double>>>, biases array<array<double>>, spec string"


def load_network(spark: SparkSession, path: str, n_folds: int = 10) -> NetworkModel:
    rows = spark.read.schema(_NETWORK).json(path).orderBy("fold").limit(n_folds).collect()
    if not rows:
        raise FileNotFoundError(f"no fold of a model in {path}")
    spec = json.loads(rows[0].spec)
    folds = [[(np.array(w), np.array(b)) for w, b in zip(r.weights, r.biases, strict=True)] for r in rows]
    return NetworkModel(spec["features"], folds, spec["back"], spec["ahead"])


def shapley_values(df: DataFrame, vector: str, trees: list[Tree], n_features: int) -> DataFrame:
    """The rows with ``shapley``, a value for each place of the vector; with the mean prediction they add up to a row's own."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series([sum((t.shapley(np.asarray(x, float), n_features) for t in trees), np.zeros(n_features)).tolist() for x in v], dtype=object)

    value = F.pandas_udf(run, T.ArrayType(T.DoubleType()))
    return df.withColumn("shapley", value(F.col(vector)))


def tree_importance(df: DataFrame, vector: str, trees: list[Tree], n_features: int, n_places: int) -> DataFrame:
    """(feature, importance): mean absolute Shapley value of each feature, summed over the window's steps."""
    parts = shapley_values(df.select(vector), vector, trees, n_places).select(F.posexplode("shapley").alias("i", "s"))
    means = parts.groupBy("i").agg(F.avg(F.abs("s")).alias("a"))
    return means.groupBy((F.col("i") % n_features).alias("feature")).agg(F.sum("a").alias("importance"))
