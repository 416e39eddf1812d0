"""Leakage-safe folds by word and by pair of keys, masks of training and validation rows, and checks of both."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import core_word, ordinal_fold
from .features import run_text
from .sequences import running

FOLDS = 10


class Lightest:
    """Folds that take weights one after another, each going to the lightest fold, the lowest-numbered one of several."""

    def __init__(self, n: int = FOLDS) -> None:
        self.heap = [(0.0, i) for i in range(n)]

    def take(self, weight: float) -> int:
        total, fold = self.heap[0]
        heapq.heapreplace(self.heap, (total + weight, fold))
        return fold

    @property
    def totals(self) -> list[float]:
        return [total for total, _ in sorted(self.heap, key=lambda x: x[1])]


def balanced(weights: list[tuple[str, float]], n: int = FOLDS) -> tuple[dict[str, int], list[float]]:
    """(fold of each item, weight of each fold), the heaviest items first."""
    folds = Lightest(n)
    return {item: folds.take(weight) for item, weight in sorted(weights, key=lambda x: -x[1])}, folds.totals


def balanced_table(weights: DataFrame, n: int = FOLDS) -> DataFrame:
    """(item, fold) of ``weights(item, weight)``, the heaviest items first, equal ones by item.

    Packing is sequential: the sorted rows stream through one task that holds the folds' totals only, so there may be any
    number of items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = Lightest(n)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folds.take(float(w)) for w in b.column(1).to_pylist()], pa.int32())], names=["item", "fold"])

    ordered = weights.select("item", F.col("weight").cast("double").alias("weight")).repartition(1).sortWithinPartitions(F.desc("weight"), "item")
    return ordered.mapInArrow(run, "item string, fold int")


def fold_of(df: DataFrame, item: Column, table: DataFrame, name: str, n: int = FOLDS) -> DataFrame:
    """``name``: the item's fold in ``table(item, fold)``, else that of its characters."""
    df = df.withColumn("__item", item)
    known = table.select(F.col("item").alias("__known"), F.col("fold").alias("__fold"))
    joined = df.join(known, F.col("__item") == F.col("__known"), "left")
    value = F.when(F.col("__item").isNull() | (F.col("__item") == ""), 0).otherwise(F.coalesce("__fold", ordinal_fold(F.col("__item"), n)))
    return joined.withColumn(name, value.cast("int")).drop("__item", "__known", "__fold")


def assign(df: DataFrame, words: DataFrame, pairs: DataFrame, sequence: str = "sequence_id", order: str = "pos", n: int = FOLDS) -> DataFrame:
    """fold_word and fold_bigram of every key; -1 on pads.

    Needs word_index (0 at a word's first key). A word takes the delimiters behind it, the ones in front of the first word
    are a group of their own; the fold is that of the letters. A pair is the key with the one before, [PAD] for the first.
    """
    start = F.when(F.col("word_index") == 0, 1).otherwise(0)
    df = df.withColumn("__start", start).withColumn("__group", F.sum("__start").over(running(sequence, order)))
    groups = run_text(df.where(F.col("key_id") > 0), sequence, order, "__group")
    folded = fold_of(groups, core_word(F.col("word")), words, "fold_word", n).select(sequence, "__group", "fold_word")
    df = df.join(folded, [sequence, "__group"], "left")
    previous = F.lag("key", 1, "[PAD]").over(Window.partitionBy(sequence).orderBy(order))
    df = fold_of(df.withColumn("__pair", F.concat(previous, "key")), F.col("__pair"), pairs, "fold_bigram", n)
    pad = F.col("key_id") == 0
    for name in ("fold_word", "fold_bigram"):
        df = df.withColumn(name, F.when(pad, -1).otherwise(F.coalesce(name, F.lit(-1))))
    return df.drop("__start", "__group", "__pair")


def masks(df: DataFrame, fold: int, either: bool = False) -> DataFrame:
    """is_train: neither fold is the one held out. is_val: the word's fold is, or with ``either`` one of both."""
    word, pair = F.col("fold_word") == fold, F.col("fold_bigram") == fold
    return df.withColumn("is_train", ~word & ~pair).withColumn("is_val", (word | pair) if either else word)


def leaks(df: DataFrame, item: str, fold: str) -> DataFrame:
    """Items that are in more than one fold; none should be."""
    return df.groupBy(item).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def balance(df: DataFrame, fold: str, weight: str) -> DataFrame:
    """(folds, mean, spread): the largest deviation of a fold's weight from the mean, as a share of it."""
    totals = df.groupBy(fold).agg(F.sum(weight).alias("total"))
    stats = totals.agg(F.count("*").alias("folds"), F.avg("total").alias("mean"), F.max("total").alias("__hi"), F.min("total").alias("__lo"))
    return stats.select("folds", "mean", (F.greatest(F.col("__hi") - F.col("mean"), F.col("mean") - F.col("__lo")) / F.col("mean")).alias("spread"))
