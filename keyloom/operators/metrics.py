"""Errors, correlations, bootstraps and the tables made of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import bits, running_total

#: Fixed value: the normal quantile of 97.5 %.
Z_975 = 1.959963984540054


def errors(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    """(by..., n, mae, r2, bias, mean_pred)."""
    e = F.col(guess) - F.col(truth)
    total = F.var_pop(truth) * F.count(truth)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total > 0, 1 - F.sum(e * e) / total).alias("r2"),
        F.avg(e).alias("bias"),
        F.avg(guess).alias("mean_pred"),
    )


def mae_interval(df: DataFrame, truth: str, guess: str, z: float = Z_975) -> DataFrame:
    """(mae, low, high) under a normal approximation with the sample deviation."""
    e = F.abs(F.col(guess) - F.col(truth))
    stats = df.agg(F.avg(e).alias("mae"), (F.stddev_samp(e) / F.sqrt(F.count(e)) * z).alias("half"))
    return stats.select("mae", (F.col("mae") - F.col("half")).alias("low"), (F.col("mae") + F.col("half")).alias("high"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman); 0 where one side does not vary. Ranks of ties are their mean.

    Distinct values are ranked, not rows: the running count over values gives every row's mean rank.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranked(column: str, name: str) -> DataFrame:
        counts = df.groupBy(F.col(column).alias(f"__{name}")).agg(F.count("*").alias("n"))
        return running_total(counts, f"__{name}", "n").select(f"__{name}", (F.col("upto") - (F.col("n") - 1) / 2).alias(name))

    both = df.join(ranked(x, "rx"), F.col(x) == F.col("__rx")).join(ranked(y, "ry"), F.col(y) == F.col("__ry"))

    def corr(a: Column, b: Column) -> Column:
        return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(0.0))

    return both.agg(corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), corr(F.col("rx"), F.col("ry")).alias("spearman"))


def clusters(df: DataFrame, cluster: str, value: Column, *by: str) -> DataFrame:
    """(by..., cluster, total, n): sums and counts by cluster. Bootstraps resample these, not the rows."""
    return df.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


#: Least draws of 32 bits that give 1, 2, 3 and so on under a Poisson distribution of mean 1.
POISSON = [math.ceil(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(11)]


def bootstrap_means(parts: DataFrame, rounds: int, seed: int, *by: str) -> DataFrame:
    """(by..., b, m): the mean over resampled clusters in each round.

    How often a round takes a cluster is drawn by hash from a Poisson distribution of mean 1, the limit of drawing as many
    clusters as there are with replacement. So clusters need no numbers, and rounds are summed before anything is shuffled.
    """
    each = parts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    keys = [F.lit(f"{seed}:"), *(x for c in (*by, "b") for x in (F.col(c).cast("string"), F.lit(":"))), F.col("cluster").cast("string")]
    drawn = each.withColumn("__u", bits(F.concat(*keys)))
    times = sum((F.col("__u") >= least).cast("int") for least in POISSON)
    sums = drawn.withColumn("__w", times).groupBy(*by, "b").agg(F.sum(F.col("__w") * F.col("total")).alias("t"), F.sum(F.col("__w") * F.col("n")).alias("n"))
    return sums.select(*by, "b", (F.col("t") / F.nullif("n", F.lit(0))).alias("m"))


def interval(df: DataFrame, value: str, *by: str, level: float = 0.95) -> DataFrame:
    """(by..., mean, low, high): exact percentiles with linear interpolation."""
    tail = (1 - level) / 2
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def bias_shift(df: DataFrame, truth: str, guess: str, cluster: str, side: str, rounds: int, seed: int) -> DataFrame:
    """(b, shift): by round, the mean over folds of the bias on side 1 less that on side 0; whole clusters are resampled by fold and side."""
    parts = clusters(df, cluster, F.col(guess) - F.col(truth), "fold", side)
    means = bootstrap_means(parts, rounds, seed, "fold", side)
    signed = means.groupBy("b", "fold").agg(F.sum(F.when(F.col(side) == 1, F.col("m")).otherwise(-F.col("m"))).alias("d"), F.count("*").alias("c"))
    return signed.where("c = 2").groupBy("b").agg(F.avg("d").alias("shift"))


def p_value(df: DataFrame, value: str, mean_ms: float = 110.5, std_ms: float = 50.4) -> DataFrame:
    """(mean, low, high, p, percent): two-sided p of bootstrap values against 0, and the mean as a share of the time."""
    stats = df.agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.025)).alias("low"),
        F.percentile(value, F.lit(0.975)).alias("high"),
        F.avg((F.col(value) <= 0).cast("double")).alias("__le"),
        F.avg((F.col(value) >= 0).cast("double")).alias("__ge"),
    )
    p = F.least(F.when(F.col("mean") > 0, F.col("__le")).otherwise(F.col("__ge")) * 2, F.lit(1.0))
    return stats.select("mean", "low", "high", p.alias("p"), (F.col("mean") * std_ms / mean_ms * 100).alias("percent"))


def pivoted(df: DataFrame, row: str, column: str, values: list[str], value: str, base: str) -> DataFrame:
    """A column for each of ``values``, and its difference from ``base``."""
    table = df.groupBy(row).pivot(column, values).agg(F.avg(value))
    return table.select(row, *values, *((F.col(v) - F.col(base)).alias(f"{v}_diff") for v in values if v != base))


def phase_table(trials: DataFrame, first: int) -> DataFrame:
    """(study, best, mean, completed, pruned) over each study's first trials by start (those without one come first)."""
    w = Window.partitionBy("study").orderBy(F.col("started").asc_nulls_first(), "trial")
    early = trials.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
    done = F.when((F.col("state") == "COMPLETE") & F.col("value").isNotNull(), F.col("value"))
    return early.groupBy("study").agg(F.min(done).alias("best"), F.avg(done).alias("mean"), F.count(done).alias("completed"), F.count(F.when(F.col("state") == "PRUNED", 1)).alias("pruned"))


def best_trials(trials: DataFrame) -> DataFrame:
    """The trial with the least value of each study."""
    done = trials.where((F.col("state") == "COMPLETE") & F.col("value").isNotNull())
    return done.groupBy("study").agg(F.min_by("trial", F.struct("value", "trial")).alias("trial"), F.min("value").alias("value"))


def importance(df: DataFrame, vector: str, weights: list[float], n_features: int) -> DataFrame:
    """(feature, importance): mean absolute share of each feature in a linear prediction, summed over the window's steps."""
    w = F.array(*map(F.lit, weights))
    means = df.agg(*(F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(len(weights))))
    mean = F.array(*(F.col(f"m{i}") for i in range(len(weights))))
    parts = df.crossJoin(F.broadcast(means)).select(F.posexplode(F.transform(F.arrays_zip(F.col(vector).alias("v"), mean.alias("m"), w.alias("w")), lambda s: F.abs((s["v"] - s["m"]) * s["w"]))).alias("i", "a"))
    return parts.groupBy("i").agg(F.avg("a").alias("a")).groupBy((F.col("i") % n_features).alias("feature")).agg(F.sum("a").alias("importance"))


def savings_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """Moments of two models' savings, the shares above 0, and their correlation."""
    out = [f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("positive", lambda c: F.avg((F.col(c) > 0).cast("double"))))]
    return df.agg(*out, F.corr(a, b).alias("pearson"))
