"""Features of single keystrokes: what a key, a pair and a triple of keys mean on a layout, and where a key stands.

Missing values are null throughout; ``windows.to_vector`` puts the sentinels in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import key_pairs, running

# Codes that part words (place features), and the fewer ones that part words for the frequency lookup.
DELIMITERS = (0, 9, 10, 13, 32, 33, 34, 40, 41, 44, 46, 58, 59, 63, 91, 93, 123, 125)
FREQUENCY_DELIMITERS = (0, 32, 33, 44, 46, 63)

_c = F.col


def _one_hand(*prefixes: str) -> Column:
    hands = [_c(f"{p}hand") for p in prefixes]
    same = hands[0].isin(0, 1)
    for a, b in zip(hands, hands[1:], strict=False):
        same = same & (a == b)
    return same


def _inward(a: str, b: str) -> Column:
    """From finger a to finger b towards the thumbs."""
    return F.when(_c(f"{b}hand") == 0, _c(f"{b}finger") > _c(f"{a}finger")).otherwise(_c(f"{b}finger") < _c(f"{a}finger"))


def _outward(a: str, b: str) -> Column:
    return F.when(_c(f"{b}hand") == 0, _c(f"{b}finger") < _c(f"{a}finger")).otherwise(_c(f"{b}finger") > _c(f"{a}finger"))


#: Pair features over the columns of a key and, with prefix p_, the one before.
BIGRAM: dict[str, Callable[[], Column]] = {
    "same_finger": lambda: (_c("p_finger") == _c("finger")) & ~_c("finger").isin(4, 5) & (_c("p_key_id") != _c("key_id")),
    "same_hand": lambda: _one_hand("p_", ""),
    "in_roll": lambda: _one_hand("p_", "") & _inward("p_", ""),
    "out_roll": lambda: _one_hand("p_", "") & _outward("p_", ""),
    "double_row_jump": lambda: (_c("p_hand") == _c("hand")) & (((_c("p_y") == -1) & _c("y").isin(1.0, 2.0)) | (_c("p_y").isin(1.0, 2.0) & (_c("y") == -1))),
    "scissors": lambda: (_c("p_hand") == _c("hand"))
    & (_c("p_key_id") != _c("key_id"))
    & (F.abs(_c("p_y") - _c("y")) >= 2)
    & (F.abs(_c("p_finger_type") - _c("finger_type")) == 1)
    & (_c("p_finger_type") < 3)
    & (_c("finger_type") < 3),
    "repetition": lambda: _c("p_key_id") == _c("key_id"),
}
#: Triple features; pp_ is the key before the one before.
TRIGRAM: dict[str, Callable[[], Column]] = {
    "same_finger_trigram": lambda: (_c("pp_finger") == _c("p_finger")) & (_c("p_finger") == _c("finger")),
    "same_finger_skipgram": lambda: (_c("pp_finger") == _c("finger")) & (_c("pp_finger") != _c("p_finger")) & (_c("pp_key_id") != _c("key_id")),
    "skipgram_repetition": lambda: (_c("pp_key_id") == _c("key_id")) & (_c("pp_key_id") != _c("p_key_id")),
    "in_triroll": lambda: _one_hand("pp_", "p_", "") & _inward("pp_", "p_") & _inward("p_", ""),
    "out_triroll": lambda: _one_hand("pp_", "p_", "") & _outward("pp_", "p_") & _outward("p_", ""),
    "redirects": lambda: _one_hand("pp_", "p_", "") & ((_inward("pp_", "p_") & _outward("p_", "")) | (_outward("pp_", "p_") & _inward("p_", ""))),
}
ATTRIBUTES = ("finger", "finger_type", "hand", "x", "y", "shift", "slot")
#: Names under which further key attributes can be asked for; functions of a frame that has the key attributes.
REGISTRY: dict[str, Callable[[], Column]] = {name: (lambda name=name: F.col(name)) for name in ATTRIBUTES} | BIGRAM | TRIGRAM


def with_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The attributes of each row's key; ``keys`` has at most 128 rows."""
    return df.join(F.broadcast(keys), "key_id", "left")


def with_previous(df: DataFrame, sequence: str, order: str = "pos", columns: tuple[str, ...] = ("key_id", "finger", "finger_type", "hand", "y", "slot")) -> DataFrame:
    """Columns of the one and two rows before, with prefixes p_ and pp_; no sequence reaches into another."""
    w = Window.partitionBy(sequence).orderBy(order)
    return df.select("*", *(F.lag(c, n).over(w).alias(f"{'p' * n}_{c}") for n in (1, 2) for c in columns))


def pair_table(spark: SparkSession, keys: DataFrame, ways: DataFrame) -> DataFrame:
    """All features of a key and of a key with the one before, for the 128 * 128 pairs of codes."""
    codes = spark.range(1 << 14).select(F.col("id").cast("int").alias("pair"), (F.col("id") % 128).cast("int").alias("key_id"), F.floor(F.col("id") / 128).cast("int").alias("p_key_id"))
    columns = ("key_id", "finger", "finger_type", "hand", "y", "slot")
    before = keys.select(*(F.col(c).alias(f"p_{c}") for c in columns))
    rows = with_keys(codes, keys).join(F.broadcast(before), "p_key_id", "left")
    return movement(pair_features(rows), ways)


def from_pairs(rows: DataFrame, pairs: DataFrame, *keep: str) -> DataFrame:
    """Layout features of rows (keep..., pair, p_pair): two joins with ``pair_table``; those of three keys follow from both pairs."""
    before = pairs.select(
        F.col("pair").alias("p_pair"), F.col("p_key_id").alias("pp_key_id"), F.col("p_finger").alias("pp_finger"), F.col("in_roll").alias("__in"), F.col("out_roll").alias("__out")
    )
    rows = rows.join(F.broadcast(pairs.drop("slot", "p_slot")), "pair").join(F.broadcast(before), "p_pair")
    valid = valid_pair() & (_c("pp_key_id") > 0)
    roll = lambda a, b: (_c(a) == 1) & (_c(b) == 1)
    rules = {name: rule() for name, rule in TRIGRAM.items() if name not in ("in_triroll", "out_triroll", "redirects")} | {
        "in_triroll": roll("__in", "in_roll"),
        "out_triroll": roll("__out", "out_roll"),
        "redirects": roll("__in", "out_roll") | roll("__out", "in_roll"),
    }
    return rows.select(*keep, "key_id", *(c for c in ATTRIBUTES if c != "slot"), *BIGRAM, *(_flag(valid, r).alias(n) for n, r in rules.items()), "move_dist", "move_sin", "move_cos")


def layout_features(df: DataFrame, text: str, pairs: DataFrame, *keep: str) -> DataFrame:
    """All features that depend on the layout, for every character of each text, without a shuffle."""
    return from_pairs(key_pairs(df, text, *keep), pairs, *keep, "pos")


def _flag(valid: Column, holds: Column) -> Column:
    return F.when(valid, F.coalesce(holds, F.lit(False)).cast("double"))


def valid_pair() -> Column:
    return (_c("key_id") > 0) & (_c("p_key_id") > 0)


def pair_features(df: DataFrame) -> DataFrame:
    """BIGRAM as 0.0 or 1.0; null where there is no pair of known keys."""
    return df.select("*", *(_flag(valid_pair(), rule()).alias(name) for name, rule in BIGRAM.items()))


def triple_features(df: DataFrame) -> DataFrame:
    return df.select("*", *(_flag(valid_pair() & (_c("pp_key_id") > 0), rule()).alias(name) for name, rule in TRIGRAM.items()))


def movement(df: DataFrame, ways: DataFrame) -> DataFrame:
    """move_dist, move_sin and move_cos of the way from the previous key; base characters only. ``ways`` is ``layout.movement_dim``."""
    return df.join(F.broadcast(ways), (_c("p_slot") == _c("slot_1")) & (_c("slot") == _c("slot_2")), "left").drop("slot_1", "slot_2")


def one_hot(column: str, n: int) -> list[Column]:
    return [F.coalesce(_c(column) == i, F.lit(False)).cast("double").alias(f"{column}_{i}") for i in range(n)]


def sequence_position(df: DataFrame, sequence: str, order: str = "pos") -> DataFrame:
    """Place, length and relative place in the sequence."""
    length = F.count("*").over(Window.partitionBy(sequence))
    df = df.withColumn("sequence_pos", (F.row_number().over(Window.partitionBy(sequence).orderBy(order)) - 1).cast("double")).withColumn("sequence_length", length.cast("double"))
    return df.withColumn("sequence_relative_pos", F.when(_c("sequence_length") > 1, _c("sequence_pos") / (_c("sequence_length") - 1)).otherwise(0.0))


def word_runs(df: DataFrame, sequence: str, order: str = "pos", delimiters: tuple[int, ...] = DELIMITERS) -> DataFrame:
    """is_delim, and run: a number that the characters of a word share within their sequence (null for delimiters)."""
    df = df.withColumn("is_delim", _c("key_id").isin(*delimiters))
    run = F.sum(_c("is_delim").cast("int")).over(running(sequence, order))
    return df.withColumn("run", F.when(~_c("is_delim"), run))


def word_position(df: DataFrame, sequence: str, order: str = "pos") -> DataFrame:
    """word_index, word_length, word_relative_pos and the start and end flags, from ``word_runs``; null (flags 0) for delimiters."""
    word = Window.partitionBy(sequence, "run")
    inside = ~_c("is_delim")
    df = df.withColumn("word_index", F.when(inside, (F.row_number().over(word.orderBy(order)) - 1).cast("double")))
    df = df.withColumn("word_length", F.when(inside, F.count("*").over(word).cast("double")))
    relative = F.when(_c("word_length") > 1, _c("word_index") / (_c("word_length") - 1)).otherwise(0.0)
    df = df.withColumn("word_relative_pos", F.when(inside, relative))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    return df.withColumn("is_word_start", flag(_c("word_index") == 0)).withColumn("is_word_end", flag(_c("word_index") == _c("word_length") - 1))


def run_text(df: DataFrame, sequence: str, order: str = "pos", run: str = "run") -> DataFrame:
    """(sequence, run, word): the text of each run, lower-cased."""
    chars = F.array_sort(F.collect_list(F.struct(order, "key_id")))
    word = F.array_join(F.transform(chars, lambda s: F.char(s["key_id"])), "")
    return df.where(_c(run).isNotNull()).groupBy(sequence, run).agg(F.lower(word).alias("word"))


def word_frequency(df: DataFrame, sequence: str, words: DataFrame, order: str = "pos", drop: str = "") -> DataFrame:
    """word_frequency of every character of a run: its word's value in ``words(word, zipf)``, 0 if it has none, null for delimiters.

    ``drop`` is left out of the word before the lookup (the one-shot key).
    """
    runs = word_runs(df, sequence, order, FREQUENCY_DELIMITERS)
    text = run_text(runs, sequence, order)
    if drop:
        text = text.withColumn("word", F.replace("word", F.lit(drop), F.lit("")))
    valued = text.join(words.select("word", "zipf"), "word", "left").select(sequence, "run", F.coalesce("zipf", F.lit(0.0)).alias("word_frequency"))
    return runs.join(valued, [sequence, "run"], "left").drop("run", "is_delim")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Left lookup of a frequency; what the table lacks is null. How large a table is depends on the corpus, so Spark picks the join."""
    return df.join(table.select(*keys, value), keys, "left")
