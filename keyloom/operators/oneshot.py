"""One-shot shift: capitals by a key that is pressed before the letter, and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import REPEAT, one_shot
from .features import word_frequency
from .models import milliseconds
from .ngrams import counted, ngrams, zipf

# Milliseconds a key.
MEAN_MS, MEDIAN_MS, STD_MS = 110.66, 100.00, 52.40


def transformed(df: DataFrame, text: str) -> DataFrame:
    """oss_text, n_oss (one-shot keys in it) and starts_oss."""
    out = df.withColumn("oss_text", one_shot(F.col(text)))
    return out.withColumn("n_oss", F.length("oss_text") - F.length(F.replace("oss_text", F.lit(REPEAT), F.lit("")))).withColumn("starts_oss", F.startswith("oss_text", F.lit(REPEAT)))


def frequencies(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Zipf tables of characters and pairs of the transformed corpus."""
    rows = df.select(one_shot(F.col(text)).alias("t"))
    return tuple(zipf(counted(ngrams(rows, "t", n, collapse=True))) for n in (1, 2))


def frequencies_of_words(chars: DataFrame, sequence: str, words: DataFrame) -> DataFrame:
    """word_frequency where the one-shot key is left out of a word before the lookup."""
    return word_frequency(chars, sequence, words, drop=REPEAT)


def patched(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """A dimension with the rows of another put in place of its own."""
    return patch.select(*table.columns).unionByName(table.join(patch.select(key), key, "left_anti"))


def report(df: DataFrame) -> DataFrame:
    """Times of both ways for rows (text, oss_text, n_oss, starts_oss, z_base, z_oss); a one-shot key at the start is free."""
    base, oss = F.length("text"), F.length("oss_text") - F.when(F.col("starts_oss"), 1).otherwise(0)
    rows = df.select(
        "*",
        milliseconds(base, F.col("z_base"), MEAN_MS, STD_MS).alias("base_mean"),
        milliseconds(oss, F.col("z_oss"), MEAN_MS, STD_MS).alias("oss_mean"),
        milliseconds(base, F.col("z_base"), MEDIAN_MS, STD_MS).alias("base_median"),
        milliseconds(oss, F.col("z_oss"), MEDIAN_MS, STD_MS).alias("oss_median"),
    )
    return rows.withColumn("oss_motion", F.col("oss_mean") - F.col("n_oss") * MEAN_MS)


def totals(df: DataFrame) -> DataFrame:
    """Speed-ups in percent by mean, by median and of the motion alone, and milliseconds lost a capital."""
    pct = lambda a, b: (F.sum(F.col(a) - F.col(b)) / F.sum(a) * 100)
    return report(df).agg(
        pct("base_mean", "oss_mean").alias("speedup_mean"),
        pct("base_median", "oss_median").alias("speedup_median"),
        pct("base_mean", "oss_motion").alias("speedup_motion"),
        (F.sum(F.col("oss_mean") - F.col("base_mean")) / F.nullif(F.sum("n_oss"), F.lit(0))).alias("ms_a_capital"),
        F.sum("n_oss").alias("n_capitals"),
    )


def encoding(chars: DataFrame, columns: list[str]) -> DataFrame:
    """The table of a text's keys and their features, the one-shot key shown as an arrow."""
    return chars.select("pos", F.translate("key", REPEAT, "⇧").alias("key"), *columns)
