"""Words in context: inverted indexes, occurrences, strips around them, and what abbreviations save there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.text import WORD, key_stream, like_capital, with_repeat_key, words
from ..sampling import first_rows

PER_WORD, LONGEST_SUFFIX = 200, 8


def word_index(df: DataFrame, text: str, key: str, per_word: int = PER_WORD) -> DataFrame:
    """(word, key, rn): the first texts of each word."""
    found = df.select(key, F.explode(F.array_distinct(words(F.lower(text)))).alias("word"))
    return first_rows(found, "word", per_word, key)


def suffix_index(index: DataFrame, longest: int = LONGEST_SUFFIX) -> DataFrame:
    """(suffix, word): proper endings of 2 letters and more of each word."""
    distinct = index.select("word").distinct().where(F.length("word") > 2)
    lengths = F.sequence(F.lit(2), F.least(F.lit(longest), F.length("word") - 1))
    return distinct.select(F.explode(lengths).alias("n"), "word").select(F.right("word", F.col("n")).alias("suffix"), "word")


def positions(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., at, body, start): each word of a text with its place, counted from 0 in characters.

    The text is cut before and behind each word; the places are sums over the pieces before.
    """
    gaps = F.split(text, WORD)
    found = words(F.col(text))
    sizes = lambda a: F.transform(a, lambda x: F.length(x))
    rows = df.select(*keep, F.posexplode(F.arrays_zip(found.alias("body"), sizes(gaps).alias("gap"), sizes(found).alias("len"))).alias("at", "z"))
    rows = rows.where(F.col("z.body").isNotNull()).select(*keep, "at", "z.body", "z.gap", "z.len")
    before = Window.partitionBy(*keep).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.sum(F.col("gap") + F.col("len")).over(before) - F.col("len")).drop("gap", "len")


def occurrences(df: DataFrame, text: str, key: str, items: DataFrame, n: int, longest: int = LONGEST_SUFFIX) -> DataFrame:
    """(item, type, key, at, body, start, rn): the first n places of each of ``items(item, type)``.

    A word is found as a whole, a suffix as the proper ending of a word; endings are joined by equality.
    """
    placed = positions(df, text, key).withColumn("low", F.lower("body"))
    whole = placed.withColumn("item", F.col("low")).join(items.where("type != 'suffix'"), "item")
    lengths = F.sequence(F.lit(2), F.least(F.lit(longest), F.length("low") - 1))
    ends = placed.where(F.length("low") > 2).withColumn("n", F.explode(lengths)).withColumn("item", F.right("low", F.col("n"))).drop("n")
    both = whole.unionByName(ends.join(items.where("type = 'suffix'"), "item"))
    return first_rows(both, ["item", "type"], n, key, "at").drop("low")


def strips(df: DataFrame, text: str, left: int, right: int, repeat_key: bool) -> DataFrame:
    """word_ks, abbr_ks, host_word, word_len, abbr_len for rows (text, start, body, item, type, abbr, trigger_form).

    Both streams have ``left`` characters before the word, filled up with blanks, and ``right`` behind it.
    """
    t, start, body = F.col(text), F.col("start"), F.col("body")
    before = F.lpad(F.substring(t, F.greatest(start - left, F.lit(0)) + 1, F.least(start, F.lit(left))), left, " ") if left else F.lit("")
    behind = start + F.length(body)
    after = F.rpad(F.when(behind < F.length(t), F.substring(t, behind + 1, F.lit(right))).otherwise(" "), right, " ") if right else F.lit("")
    keyed = with_repeat_key if repeat_key else (lambda c: c)
    stream = key_stream(F.col("abbr"), F.col("trigger_form"), repeat_key)
    stem = F.left(body, F.length(body) - F.length("item"))
    suffix = F.col("type") == "suffix"
    word, abbr = keyed(body), F.when(suffix, F.concat(keyed(stem), stream)).otherwise(like_capital(body, stream))
    return df.select(
        "*",
        F.concat(before, word, after).alias("word_ks"),
        F.concat(before, abbr, after).alias("abbr_ks"),
        F.lower(body).alias("host_word"),
        F.length(word).alias("word_len"),
        F.length(abbr).alias("abbr_len"),
    )


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def quadrature(a: Column, b: Column, weight: Column) -> Column:
    """The deviation of a weighted mean of differences from the deviations of both sides."""
    return F.sqrt(F.sum((a * a + b * b) * weight * weight) / (F.sum(weight) * F.sum(weight) + 1e-12))
