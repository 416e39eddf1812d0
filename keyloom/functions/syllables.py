"""Syllables by vowel groups. The usual hyphenation patterns are not at hand, so borders may differ from a dictionary's.

A word is cut before the last consonant between two vowel groups; a final silent e makes no syllable.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = frozenset("aeiou")
_GROUP = re.compile("[aeiouy]+")


def syllables(word: str) -> list[str]:
    """The word in parts that join to it."""
    groups = [m.span() for m in _GROUP.finditer(word.lower()) if m.start() or word[0].lower() != "y"]
    if len(groups) > 1 and word.lower().endswith("e") and groups[-1] == (len(word) - 1, len(word)) and word[-2:-1].lower() != "l":
        groups.pop()
    cuts = [0]
    for (_, end), (start, _) in zip(groups, groups[1:], strict=False):
        cuts.append(end if start - end <= 1 else start - 1)
    cuts = [*dict.fromkeys(c for c in cuts if c < len(word)), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if word else []


def first_syllable(word: str) -> str | None:
    """Up to the first consonant behind a vowel; None for words of two letters or without one."""
    seen = False
    for i, c in enumerate(word) if len(word) > 2 else ():
        if c in VOWELS:
            seen = True
        elif seen:
            return word[: i + 1]
    return None


@lru_cache(1 << 14)
def acronym(word: str) -> str | None:
    """The first letters of the syllables, if there are at least two."""
    parts = syllables(word)
    return "".join(p[0] for p in parts) if len(parts) > 1 else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _sizes(words: pd.Series) -> pd.Series:
    return words.map(lambda w: [len(p) for p in syllables(w or "")])


def positions(df: DataFrame, sequence: str, order: str = "pos") -> DataFrame:
    """is_syllable_start and is_syllable_end of every character of a word (null for delimiters); needs run and word_index.

    Only distinct words go through Python.
    """
    from ..operators.features import run_text

    runs = run_text(df, sequence, order)
    sizes = runs.select("word").distinct().withColumn("sizes", _sizes("word"))
    ends = F.aggregate("sizes", F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    cut = runs.join(sizes, "word").select(sequence, "run", ends.alias("ends"))
    joined = df.join(cut, [sequence, "run"], "left")
    at = F.col("word_index").cast("int")
    flag = lambda c: F.when(F.col("run").isNotNull(), c.cast("double"))
    start = (at == 0) | F.array_contains("ends", at)
    return joined.withColumn("is_syllable_start", flag(start)).withColumn("is_syllable_end", flag(F.array_contains("ends", at + 1))).drop("ends")
