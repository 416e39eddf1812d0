"""Speed models: ensembles over folds, sums of predicted costs, and training with Spark's learners or a small network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import to_vector


def linear(vector: str | Column, weights: list[float], bias: float = 0.0) -> Column:
    """A linear prediction of an array column."""
    products = F.zip_with(vector, F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(bias)), lambda acc, p: acc + p)


def ensemble(vector: str, folds: list[tuple[list[float], float]]) -> tuple[Column, Column]:
    """(mean, population deviation) of the folds' predictions."""
    guesses = F.array(*(linear(vector, w, b) for w, b in folds))
    mean = F.aggregate(guesses, F.lit(0.0), lambda a, g: a + g) / len(folds)
    square = F.aggregate(guesses, F.lit(0.0), lambda a, g: a + (g - mean) * (g - mean)) / len(folds)
    return mean, F.sqrt(square)


def costs(df: DataFrame, texts: DataFrame, text_id: str, mean: str, std: str, first: Column | int = 1, last: Column | None = None, pos: str = "pos") -> DataFrame:
    """(text_id, cost, std): sums of means and root of summed squares over the keys from ``first`` to before ``last``; 0 for texts without any.

    The first key of a text is never counted.
    """
    used = (F.col(pos) >= first) & (F.col(pos) >= 1)
    if last is not None:
        used = used & (F.col(pos) < last)
    sums = df.where(used).groupBy(text_id).agg(F.sum(mean).alias("cost"), F.sqrt(F.sum(F.col(std) * F.col(std))).alias("std"))
    return texts.select(text_id).join(sums, text_id, "left").na.fill(0.0, ["cost", "std"])


def per_key(df: DataFrame, length: str) -> DataFrame:
    """mean_z and std_z of a text: its cost by key and the root mean square of the deviations."""
    n = F.greatest(F.col(length) - 1, F.lit(1))
    return df.withColumn("mean_z", F.col("cost") / n).withColumn("std_z", F.col("std") / F.sqrt(n))


def milliseconds(length: Column, cost: Column, mean_ms: float, std_ms: float) -> Column:
    return F.greatest(F.lit(0), length - 1) * F.lit(mean_ms) + cost * F.lit(std_ms)


def scored(df: DataFrame, features: list[str], folds: list[tuple[list[float], float]], sequence: str, order: str, back: int, ahead: int) -> DataFrame:
    """pred_mean and pred_std of each key from its window."""
    framed = to_vector(df, features, sequence, order, back, ahead)
    mean, std = ensemble("window", folds)
    return framed.withColumn("pred_mean", mean).withColumn("pred_std", std).drop("window")


def out_of_fold(df: DataFrame, row: str, guess: str) -> DataFrame:
    """Mean of the predictions that a row got from several folds."""
    return df.groupBy(row).agg(F.avg(guess).alias(guess))


def standardised(df: DataFrame, vector: str, n: int) -> DataFrame:
    """The vector with each place's mean and population deviation taken out; places that do not vary stay 0."""
    stats = df.agg(*(f(F.get(vector, F.lit(i))).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    place = lambda k: F.array(*(F.col(f"{k}{i}") for i in range(n)))
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("v"), place("m").alias("m"), place("s").alias("s")), lambda x: F.when(x["s"] > 0, (x["v"] - x["m"]) / x["s"]).otherwise(0.0))
    return df.crossJoin(F.broadcast(stats)).withColumn(vector, scaled).drop(*(f"{k}{i}" for i in range(n) for k in "ms"))


def _ml_vector(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_linear(df: DataFrame, vector: str, target: str, *, reg: float = 0.0, l1_share: float = 0.0) -> tuple[list[float], float]:
    """(weights, bias) of a linear model; robust loss without an L1 term, squared loss with one."""
    from pyspark.ml.regression import LinearRegression

    loss = {"loss": "huber"} if not l1_share else {"loss": "squaredError"}
    model = LinearRegression(featuresCol="__features", labelCol=target, regParam=reg, elasticNetParam=l1_share, maxIter=50, **loss).fit(_ml_vector(df, vector))
    return [float(w) for w in model.coefficients], float(model.intercept)


#: Least residual in the weights of absolute loss, and change of the weights at which the fit has settled.
LEAST_RESIDUAL, SETTLED = 1e-6, 1e-7


def _normal_equations(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, total = shared.value, 0.0
        for b in batches:
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, len(beta) - 1))
            x, y = np.append(x, np.ones((len(x), 1)), axis=1), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            w = 1 / np.maximum(np.abs(y - x @ beta), LEAST_RESIDUAL) if beta.any() else np.ones(len(y))
            both = np.append(x, y[:, None], axis=1)
            total = total + both.T @ (both * w[:, None])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 8]), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    return run


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(v.as_py(), float) for b in batches for v in b.column("sums"))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_absolute(df: DataFrame, vector: str, target: str, n: int, *, l1: float = 0.0, l2: float = 0.0, rounds: int = 50) -> tuple[list[float], float]:
    """(weights, bias) that minimise the mean absolute error plus ``l1`` times the weights' sum of sizes and half ``l2`` times that of squares.

    Reweighted least squares: in each round every partition adds up its normal equations, of a size that the number of
    features fixes, with rows weighted by what makes their square an absolute value; a penalty is met by coordinate descent.
    """
    rows, beta = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")), np.zeros(n + 1)
    count = 0.0
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(beta)
        sums = rows.mapInArrow(_normal_equations(shared), "slot long, sums binary").groupBy("slot").applyInArrow(_summed, "sums binary").collect()
        if not sums:
            break
        whole = sum(np.frombuffer(bytes(r.sums), float) for r in sums).reshape(n + 2, n + 2)
        gram, right, size = whole[:-1, :-1], whole[:-1, -1], max(whole[n, n], 1e-12)
        gram, right, new = gram / size, right / size, beta.copy()
        # In the first round all rows weigh 1, so their weights add up to their number. The bias, in the last place, bears no penalty.
        count = count or whole[n, n]
        scale = count / size
        if l1 == 0:
            new = np.linalg.lstsq(gram + np.diag([l2 * scale] * n + [0.0]), right, rcond=None)[0]
        else:
            for _sweep in range(200):
                old = new.copy()
                for j in range(n + 1):
                    if gram[j, j] <= 0:
                        continue
                    part = right[j] - gram[j] @ new + gram[j, j] * new[j]
                    new[j] = part / gram[j, j] if j == n else np.sign(part) * max(abs(part) - l1 * scale, 0.0) / (gram[j, j] + l2 * scale)
                if np.abs(new - old).max() < SETTLED:
                    break
        moved, beta = np.abs(new - beta).max(), new
        if moved < SETTLED:
            break
    return beta[:n].tolist(), float(beta[n])


def selected_features(weights: list[float], features: list[str]) -> list[str]:
    """Features with a weight other than 0 in any step of the window."""
    n = len(features)
    return [f for i, f in enumerate(features) if any(abs(w) > 1e-12 for w in weights[i::n])]


def l1_path(df: DataFrame, vector: str, target: str, features: list[str], strengths: list[float]) -> list[tuple[float, list[str]]]:
    return [(s, selected_features(fit_linear(df, vector, target, reg=s, l1_share=1.0)[0], features)) for s in strengths]


def fit_trees(df: DataFrame, vector: str, target: str, *, val: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Boosted trees under absolute loss; with a validation flag they stop when it gains no more."""
    from pyspark.ml.regression import GBTRegressor

    learner = GBTRegressor(featuresCol="__features", labelCol=target, lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed)
    if val:
        learner = learner.setValidationIndicatorCol(val)
    return learner.fit(_ml_vector(df, vector))


def predict_trees(model, df: DataFrame, vector: str, name: str = "prediction") -> DataFrame:
    return model.setPredictionCol(name).transform(_ml_vector(df, vector)).drop("__features")


def train_network(
    x: np.ndarray, y: np.ndarray, hidden: int | tuple[int, ...] = 16, epochs: int = 30, rate: float = 0.01, decay: float = 0.0, held: float = 0.0, patience: int = 5, seed: int = 42
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of each layer of a network with rectified hidden layers under absolute loss.

    Fitted by Adam with decoupled weight decay in mini-batches. With ``held``, that share of the rows is kept back: the rate is
    halved when their error has not fallen for two epochs, training stops after ``patience`` of them, and the best layers stay.
    """
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *([hidden] if isinstance(hidden, int) else hidden)]
    layers = [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    layers.append((rng.normal(0, sizes[-1] ** -0.5, (sizes[-1], 1)), np.array([float(np.median(y))])))
    mixed = rng.permutation(len(x))
    kept, fitted = mixed[: int(held * len(x))], mixed[int(held * len(x)) :]
    moments = [[(np.zeros_like(p), np.zeros_like(p)) for p in layer] for layer in layers]
    best, best_error, stale, t = layers, np.inf, 0, 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fitted), max(1, len(fitted) // 256)):
            states = [x[at]]
            for w, b in layers[:-1]:
                states.append(np.maximum(states[-1] @ w + b, 0))
            back = np.sign(states[-1] @ layers[-1][0] + layers[-1][1] - y[at][:, None]) / len(at)
            t += 1
            new = []
            for i in range(len(layers) - 1, -1, -1):
                (w, b), grads = layers[i], (states[i].T @ back, back.sum(axis=0))
                if i:
                    back = back @ w.T * (states[i] > 0)
                moved = []
                for p, g, (m, v), shrink in zip((w, b), grads, moments[i], (decay, 0.0), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    moved.append(p - rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + shrink * p))
                new.append(tuple(moved))
            layers = new[::-1]
        if len(kept):
            error = float(np.abs(network(layers, x[kept]) - y[kept]).mean())
            best, best_error, stale = (layers, error, 0) if error < best_error else (best, best_error, stale + 1)
            rate *= 0.5 if stale and stale % 2 == 0 else 1.0
            if stale >= patience:
                break
    return best if len(kept) else layers


def network(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    return (x @ layers[-1][0] + layers[-1][1])[:, 0]


def cross_validated_network(df: DataFrame, vector: str, target: str, fold: str, key: str, n_folds: int, max_fit: int = 20_000, **params) -> DataFrame:
    """(key, prediction): each row by the network of its fold, fitted on rows of the other folds.

    A fold's network is fitted in one task on the ``max_fit`` rows with the smallest hashes of their keys; all rows are scored.
    """
    rows = df.select(key, vector, target, fold)
    # Each row trains the folds that it is not in.
    train = rows.select(key, vector, target, F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: i != F.col(fold))).alias("net"))
    from .sampling import first_rows

    sample = first_rows(train, "net", max_fit, F.xxhash64(key), key)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        layers = train_network(np.stack(frame[vector].to_numpy()).astype(float), frame[target].to_numpy(float), **params)
        return pd.DataFrame({"net": [int(frame["net"].iloc[0])], "w": [[w.ravel().tolist() for w, _ in layers]], "b": [[b.tolist() for _, b in layers]]})

    trained = sample.groupBy("net").applyInPandas(fit, "net int, w array<array<double>>, b array<array<double>>").collect()
    nets = {r.net: [(np.array(w).reshape(-1, len(b)), np.array(b)) for w, b in zip(r.w, r.b, strict=True)] for r in trained}

    def guess(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f))
            x = np.stack(f[vector].to_numpy()).astype(float) if len(f) else np.zeros((0, 1))
            for net, layers in nets.items():
                at = (f[fold] == net).to_numpy()
                out[at] = network(layers, x[at])
            yield pd.DataFrame({key: f[key], "prediction": out})

    return rows.mapInPandas(guess, f"{key} {dict(df.dtypes)[key]}, prediction double")
