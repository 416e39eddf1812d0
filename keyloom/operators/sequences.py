"""Timed key sequences: characters as rows, intervals, outliers, normalisation, splitting at typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TYPO_TYPES = ("Substitution", "Insertion", "Deletion", "Transposition", "Proofreading")


def running(by: str | list[str], *order: str):
    """All rows of a group up to the current one."""
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def key_id(key: Column) -> Column:
    """The first character's code below 128, else 0."""
    return F.when((F.length(key) > 0) & (F.ascii(key) < 128), F.ascii(key)).otherwise(0)


def key_name(code: Column) -> Column:
    return F.when(code == 0, "[PAD]").otherwise(F.char(code))


def characters(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row (keep..., pos, key, key_id) for each character of a text."""
    rows = df.select(*keep, F.posexplode(F.split(text, "")).alias("pos", "key")).where(F.col("key") != "")
    return rows.withColumn("key_id", key_id(F.col("key")))


def key_pairs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., pos, pair, p_pair) for each character: its code and the one before as one number (before * 128 + code), and that number of the character before.

    Codes from 128 on, and what is before the start, count as 0. The pairs are made within the text's own row, so that
    neither a shuffle nor a sort is needed.
    """
    codes = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c)).otherwise(0))
    none = F.array(F.lit(0))
    rows = df.where(F.length(text) > 0).select(*keep, codes.alias("__c"))
    rows = rows.select(*keep, F.zip_with(F.concat(none, F.slice("__c", F.lit(1), F.size("__c") - 1)), "__c", lambda p, c: p * 128 + c).alias("__p"))
    zipped = F.arrays_zip(F.col("__p").alias("pair"), F.concat(none, F.slice("__p", F.lit(1), F.size("__p") - 1)).alias("p_pair"))
    return rows.select(*keep, F.posexplode(zipped).alias("pos", "__z")).select(*keep, "pos", "__z.pair", "__z.p_pair")


def intervals(df: DataFrame, group: str, order: list[str], time: str = "time") -> DataFrame:
    """iki: the time since the group's previous row; null for the first."""
    return df.withColumn("iki", F.col(time) - F.lag(time).over(Window.partitionBy(group).orderBy(*order)))


def split_at_outliers(df: DataFrame, participant: str, sequence: str, order: list[str], iki: str = "iki", sds: float = 4.0) -> DataFrame:
    """segment: how many rows of the sequence so far took longer than the participant's mean and ``sds`` sample deviations."""
    mine = Window.partitionBy(participant)
    limit = F.avg(iki).over(mine) + sds * F.stddev_samp(iki).over(mine)
    late = F.when(F.col(iki) > limit, 1).otherwise(0)
    return df.withColumn("is_outlier", late).withColumn("segment", F.sum("is_outlier").over(running([participant, sequence] if participant != sequence else sequence, *order)))


def rebase(df: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    return df.withColumn(time, F.col(time) - F.min(time).over(Window.partitionBy(*by)))


def z_scores(df: DataFrame, participant: str, iki: str = "iki") -> DataFrame:
    """iki_z and iki_log_z of positive intervals under their participant's population moments; null where those are none.

    Participants with fewer than two positive intervals go.
    """
    mine = Window.partitionBy(participant)
    good = F.when(F.col(iki) > 0, F.col(iki).cast("double"))
    df = df.withColumn("__v", good).withColumn("__l", F.log(good)).withColumn("__n", F.count("__v").over(mine)).where("__n > 1")
    score = lambda c: (F.col(c) - F.avg(c).over(mine)) / F.nullif(F.stddev_pop(c).over(mine), F.lit(0.0))
    return df.withColumn("iki_z", score("__v")).withColumn("iki_log_z", score("__l")).drop("__v", "__l", "__n")


def normalise(df: DataFrame, sds: float = 4.0) -> DataFrame:
    """The whole step over (participant_id, sequence_id, key, time, ...): split at outliers, re-base, score."""
    timed = intervals(df, "sequence_id", ["time"])
    cut = split_at_outliers(timed, "participant_id", "sequence_id", ["time"], sds=sds)
    named = cut.withColumn("sequence_id", F.concat_ws("_", "sequence_id", "segment")).drop("is_outlier", "segment")
    based = intervals(rebase(named, ["sequence_id"]), "sequence_id", ["time"])
    return z_scores(based, "participant_id").withColumn("key_id", key_id(F.col("key")))


def split_at_typos(
    df: DataFrame, sequence: str, order: list[str], typo_type: Column, keep: dict[str, bool], time: str = "time"
) -> DataFrame:
    """Rows of unwanted types go, and each starts a new part of its sequence, as does the second of two adjacent kept deletions.

    Adds part (numbers may be skipped) and re-bases the time on the part's first kept row.
    """
    dropped = [t for t, kept in keep.items() if not kept]
    gone = F.coalesce(typo_type.isin(dropped), F.lit(False)) if dropped else F.lit(False)
    df = df.withColumn("__gone", gone).withColumn("__type", typo_type)
    again = F.lit(False)
    if keep.get("Deletion", True):
        previous = F.lag("__type").over(Window.partitionBy(sequence).orderBy(*order))
        again = F.coalesce((F.col("__type") == "Deletion") & (previous == "Deletion"), F.lit(False))
    df = df.withColumn("__cut", F.when(F.col("__gone") | again, 1).otherwise(0))
    df = df.withColumn("part", F.sum("__cut").over(running(sequence, *order))).where(~F.col("__gone"))
    return rebase(df, [sequence, "part"], time).drop("__gone", "__type", "__cut")


def first_sequences(df: DataFrame, sequence: str, order: str, n: int) -> DataFrame:
    """Rows of the n sequences that come first."""
    first = df.groupBy(sequence).agg(F.min(order).alias("__first")).orderBy("__first", sequence).limit(n)
    return df.join(first.select(sequence), sequence, "left_semi")
