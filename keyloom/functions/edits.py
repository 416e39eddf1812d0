"""Edit scripts with adjacent transpositions, and the labels of typing errors that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def edit_script(target: str, typed: list[str] | str) -> list[tuple[str, int | None, int | None]]:
    """(op, place in target, place in typed) with ops M, S, I, D, T; the least number of errors.

    Among equally good scripts the diagonal step is preferred, then insertion, deletion, transposition.
    """
    n, m = len(target), len(typed)
    width = m + 1
    cost = [0] * ((n + 1) * width)
    how = bytearray(b"I" * len(cost))
    cost[:width] = range(width)
    for i in range(1, n + 1):
        row = i * width
        cost[row], how[row] = i, ord("D")
        for j in range(1, width):
            here = row + j
            match = target[i - 1] == typed[j - 1]
            options = [(cost[here - width - 1] + (not match), b"M" if match else b"S"), (cost[here - 1] + 1, b"I"), (cost[here - width] + 1, b"D")]
            swapped = i > 1 and j > 1 and target[i - 2] == typed[j - 1] and target[i - 1] == typed[j - 2]
            if swapped and target[i - 2] != target[i - 1]:
                options.append((cost[here - 2 * width - 2] + 1, b"T"))
            best = min(options, key=lambda o: o[0])
            cost[here], how[here] = best[0], best[1][0]
    script, i, j = [], n, m
    while i or j:
        op = chr(how[i * width + j])
        back_i, back_j = {"I": (0, 1), "D": (1, 0), "T": (2, 2)}.get(op, (1, 1))
        i, j = i - back_i, j - back_j
        script.append((op, i if back_i else None, j if back_j else None))
    return script[::-1]


def label(script: list[tuple[str, int | None, int | None]], n: int, corrected: list[bool]) -> list[str | None]:
    """The error type of each of n typed keys; a key typed after a correction is a proofreading one whatever else it is."""
    labels: list[str | None] = [None] * n
    names = {"S": "Substitution", "I": "Insertion", "T": "Transposition"}
    for op, _, j in script:
        if op in names:
            for k in (j, j + 1) if op == "T" else (j,):
                if k < n:
                    labels[k] = names[op]
    for at, (op, _, _) in enumerate(script):
        if op == "D":
            before = next((j for _, _, j in reversed(script[:at]) if j is not None), None)
            after = next((j for _, _, j in script[at + 1 :] if j is not None), None)
            for k in (before, after):
                if k is not None and labels[k] is None:
                    labels[k] = "Deletion"
    return ["Proofreading" if c else x for x, c in zip(labels, corrected, strict=True)]


@F.pandas_udf(OPS)
def edit_ops(target: pd.Series, typed: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else [{"op": o, "i": i, "j": j} for o, i, j in edit_script(a, b)] for a, b in zip(target, typed, strict=True)])


def replay(df: DataFrame, group: list[str], order: list[str], key: str, time: str, *, erase: str = "BKSP", ignore: str = "SHIFT") -> DataFrame:
    """A row (group..., pos, key, time, corrected) for each key that is left at the end.

    Keys are folded over in order, within each group's array: a stack of structs, and whether the last key was taken back.
    """
    entry = "struct<key:string,time:bigint,corrected:boolean>"
    keys = F.array_sort(F.collect_list(F.struct(*order, F.col(key).cast("string").alias("__key"), F.col(time).cast("long").alias("__time"))))
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.lit(False).alias("back"))

    def step(acc: Column, k: Column) -> Column:
        stack, back = acc["stack"], acc["back"]
        pushed = F.concat(stack, F.array(F.struct(k["__key"].alias("key"), k["__time"].alias("time"), back.alias("corrected"))))
        popped = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        erased = F.struct(popped.alias("stack"), (back | (F.size(stack) > 0)).alias("back"))
        typed = F.struct(pushed.alias("stack"), F.lit(False).alias("back"))
        return F.when(k["__key"] == ignore, acc).when(k["__key"] == erase, erased).otherwise(typed)

    left = df.groupBy(*group).agg(keys.alias("__keys")).withColumn("__left", F.aggregate("__keys", start, step)["stack"])
    return left.select(*group, F.posexplode("__left").alias("pos", "__e")).select(*group, "pos", "__e.*")


def annotate(df: DataFrame) -> DataFrame:
    """Raw keystrokes (schema.KEYSTROKES) to sequences with typing errors (schema.SEQUENCE); a section is one group of rows.

    Keys are replayed and compared with the section's sentence in pandas; sections are small, many go in one batch.
    """
    clean = df.na.drop(subset=["PRESS_TIME", "LETTER", "TEST_SECTION_ID"])
    section = F.col("TEST_SECTION_ID").cast("double").cast("long").cast("string")
    clean = clean.select(
        F.col("PARTICIPANT_ID").alias("participant_id"), F.concat_ws("_", "PARTICIPANT_ID", section).alias("sequence_id"), "SENTENCE", F.col("PRESS_TIME").cast("long").alias("t"), "LETTER"
    ).withColumn("n", F.monotonically_increasing_id())
    target = clean.groupBy("participant_id", "sequence_id").agg(F.min_by("SENTENCE", F.struct("t", "n")).alias("target"))
    left = replay(clean, ["participant_id", "sequence_id"], ["t", "n"], "LETTER", "t")
    stacks = left.groupBy("participant_id", "sequence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "time", "corrected"))).alias("stack")).join(target, ["participant_id", "sequence_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                keys = [k["key"] for k in r.stack]
                types = label(edit_script(r.target or "", keys), len(keys), [k["corrected"] for k in r.stack])
                rows += [
                    (r.participant_id, r.sequence_id, r.sequence_id, k["key"], k["time"] - r.stack[0]["time"], t is not None, t) for k, t in zip(r.stack, types, strict=True)
                ]
            yield pd.DataFrame(rows, columns=["participant_id", "sequence_id", "original_sequence_id", "key", "time", "is_typo", "typo_type"])

    return stacks.mapInPandas(run, "participant_id string, sequence_id string, original_sequence_id string, key string, time long, is_typo boolean, typo_type string")
