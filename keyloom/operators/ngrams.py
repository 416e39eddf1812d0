"""N-gram, word and suffix counts of a corpus, their Zipf values, and frequency tables for further keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import REPEAT, TRIGGER, tokens

MIN_COUNT = 5


def _grams(chars: Column, n: int) -> Column:
    if n == 1:
        return F.filter(chars, lambda c: c != "")
    size = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    grams = F.slice(chars, 1, size)
    for i in range(1, n):
        grams = F.zip_with(grams, F.slice(chars, i + 1, size), lambda a, b: F.concat(a, b))
    return grams


def ngrams(df: DataFrame, text: str, n: int, *keep: str, collapse: bool = False) -> DataFrame:
    """(keep..., gram) for each n characters in a row of each text; ``collapse`` makes white space single blanks first."""
    value = F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else F.col(text)
    return df.select(*keep, value.alias("__t")).where(F.length("__t") >= n).select(*keep, F.explode(_grams(F.split("__t", ""), n)).alias("gram"))


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(at, tail, head) in order -> (at, tail, head, next) for each text but the last of the task, and a border: first at and head, last tail."""
    first = last = None
    for f in frames:
        if not len(f):
            continue
        if first is None:
            first = f.iloc[0]
        tails = f["tail"].shift(1, fill_value=last)
        inner = pd.DataFrame({"at": f["at"], "tail": tails, "head": None, "next": f["head"]})
        yield inner if last is not None else inner.iloc[1:]
        last = f["tail"].iloc[-1]
    if first is not None:
        yield pd.DataFrame({"at": [first["at"]], "tail": [last], "head": [first["head"]], "next": [None]})


def crossing(df: DataFrame, text: str, n: int, order: str) -> DataFrame:
    """(gram) for the n-grams that span two texts, as if all were joined by a blank in order; empty texts fall out first.

    Only the last and first n-1 characters of each text take part. They are dealt by ranges of the order; a task joins what
    follows each other within its range, and gives its first head and last tail, of which one window over a row for each
    range makes the rest.
    """
    ends = df.select(order, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("__t")).where(F.length("__t") > 0)
    ends = ends.select(order, F.right("__t", F.lit(n - 1)).alias("tail"), F.left("__t", F.lit(n - 1)).alias("head"))
    ranged = ends.select(F.col(order).alias("at"), "tail", "head").repartitionByRange("at").sortWithinPartitions("at")
    met = ranged.mapInPandas(_neighbours, T.StructType([ranged.schema["at"], *(T.StructField(c, T.StringType()) for c in ("tail", "head", "next"))]))
    # Rows of neighbours are spread; those of borders, whose next is not known, meet in one group.
    group = F.when(F.col("next").isNull(), F.lit(0)).otherwise(F.xxhash64("at"))
    following = F.coalesce("next", F.lead("head").over(Window.partitionBy(group).orderBy("at")))
    joint = met.select("tail", following.alias("next")).where(F.col("next").isNotNull())
    both = joint.select(F.split(F.concat("tail", F.lit(" "), "next"), "").alias("chars"), F.length("tail").alias("at"))
    numbered = both.select(F.posexplode(_grams(F.col("chars"), n)).alias("i", "gram"), "at")
    return numbered.where((F.col("i") <= F.col("at")) & (F.col("i") + n > F.col("at"))).select("gram")


def counted(df: DataFrame, column: str = "gram") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def zipf(counts: DataFrame, column: str = "gram", least: int = MIN_COUNT) -> DataFrame:
    """(column, n, p, zipf) of what occurs often enough; shares are of the kept total, zipf is log10(p) + 9 within 0 to 10."""
    kept = counts.where(F.col("n") >= least)
    total = kept.agg(F.sum("n").alias("total"))
    share = kept.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))
    return share.select(column, "n", "p", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.log10("p") + 9)).alias("zipf"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top(counts: DataFrame, column: str, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), column).limit(k)


def suffix_counts(words: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """(suffix, n, n_words) from (word, n): a word is a suffix of itself. Words are counted before they are taken apart."""
    lengths = F.sequence(F.lit(low), F.least(F.lit(high), F.length("word")))
    apart = words.where(F.length("word") >= low).select("word", "n", F.explode(lengths).alias("len"))
    return apart.select(F.right("word", F.col("len")).alias("suffix"), "n").groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("n_words"))


def suffixes(words: DataFrame, *, low: int = 2, high: int = 6, min_words: int = 50, exclude: DataFrame | None = None, top_k: int = 500) -> DataFrame:
    found = suffix_counts(words, low, high).where(F.col("n_words") >= min_words)
    if exclude is not None:
        found = found.join(exclude.select(F.col("word").alias("suffix")), "suffix", "left_anti")
    return top(found, "suffix", top_k)


def log_sum(zipfs: Column) -> Column:
    """log10 of the sum of 10 to the power of each value."""
    return F.log10(F.sum(F.pow(F.lit(10.0), zipfs)))


def trigger_bigrams(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(gram, zipf) of the pairs that abbreviations end in, from ``entries(text, abbr, trigger_form)`` and ``words(word, zipf)``."""
    valued = entries.join(words, F.lower("text") == F.col("word")).where("zipf > 0")
    last, first = F.right("abbr", F.lit(1)), F.left("abbr", F.lit(1))
    keys = F.when(F.col("trigger_form") == "trg", F.array(F.concat(last, F.lit(TRIGGER)))).when(
        F.col("trigger_form") == "rpt_trg", F.array(F.concat(first, F.lit(REPEAT)), F.lit(REPEAT + TRIGGER))
    )
    return valued.select(F.explode(keys).alias("gram"), "zipf").groupBy("gram").agg(log_sum(F.col("zipf")).alias("zipf"))


def augmented(unigrams: DataFrame, bigrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequency tables with the trigger and repeat keys, from (gram, zipf).

    The repeat key is as frequent as all doubled letters, the trigger as the mean pair; a pair with one of them and a letter
    is one less than the letter, at least 0, and pairs of the two keys are as the mean pair.
    """
    doubled = bigrams.where(F.substring("gram", 1, 1) == F.substring("gram", 2, 1)).agg(log_sum(F.col("zipf")).alias("r"))
    mean = bigrams.agg(F.avg("zipf").alias("m"))
    both = mean.crossJoin(doubled)
    extra_one = both.select(F.explode(F.array(F.struct(F.lit(TRIGGER).alias("gram"), F.col("m").alias("zipf")), F.struct(F.lit(REPEAT).alias("gram"), F.col("r").alias("zipf")))).alias("e")).select("e.*")
    letters = unigrams.where(F.col("gram").rlike("^[a-z]$")).select("gram", F.greatest(F.lit(0.0), F.col("zipf") - 1).alias("zipf"))
    sides = F.array(*(F.concat(F.lit(k), F.col("gram")) if front else F.concat(F.col("gram"), F.lit(k)) for k in (TRIGGER, REPEAT) for front in (True, False)))
    pairs = letters.select(F.explode(sides).alias("gram"), "zipf")
    own = F.array(*(F.lit(a + b) for a in (TRIGGER, REPEAT) for b in (TRIGGER, REPEAT)))
    extra_two = pairs.unionByName(mean.select(F.explode(own).alias("gram"), F.col("m").alias("zipf")))
    return unigrams.select("gram", "zipf").unionByName(extra_one), bigrams.select("gram", "zipf").unionByName(extra_two)
