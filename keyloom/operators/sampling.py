"""Samples that come out alike in every run and engine: draws are the first 32 bits of an md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw(seed: int | str, *key: str) -> Column:
    """An integer below 2**32 from a seed and columns."""
    return bits(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def take(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows at random: those with the smallest draws."""
    return df.withColumn("__d", draw(seed, *key)).orderBy("__d", *key).limit(n).drop("__d")


def weighted_order(df: DataFrame, weight: str, seed: int, *key: str) -> DataFrame:
    """rank: the order of a weighted sample without replacement, by -ln(u) / weight (Efraimidis and Spirakis)."""
    u = (draw(seed, *key) + 1) / F.lit(4294967297.0)
    cost = -F.log(u) / F.greatest(F.col(weight), F.lit(1))
    return running_total(df.withColumn("cost", cost).withColumn("__one", F.lit(1)), "cost", "__one", *key).withColumnRenamed("upto", "rank").drop("__one")


#: Parts into which values are dealt for a running total.
PARTS = 64


def running_total(df: DataFrame, value: str, n: str, *ties: str) -> DataFrame:
    """upto: the sum of ``n`` over all rows up to this one in order of a number and ``ties``.

    Values are dealt at their approximate quantiles, summed up within each part, and what all parts before have is added;
    so no window holds more than about a part of the rows.
    """
    edges = sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / PARTS for i in range(1, PARTS)], 0.25 / PARTS)))
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < F.col(value))) if edges else F.lit(0)
    dealt = df.withColumn("__part", part)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.sum(n).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("__part").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0)
    # ``starts`` has PARTS rows at most.
    summed = dealt.withColumn("upto", F.sum(n).over(inner)).join(F.broadcast(starts), "__part")
    return summed.withColumn("upto", F.col("upto") + F.col("__start")).drop("__part", "__start")


def first_rows(df: DataFrame, by: str | list[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group."""
    by = [by] if isinstance(by, str) else by
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)
