"""Choosing a dictionary: linking, short lists, overlaps, and the best set under its constraints."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 100_000
MIN_SAVING = 0.25


def effective(mean: Column, std: Column, sigma: float) -> Column:
    return F.coalesce(mean, F.lit(0.0)) - sigma * F.coalesce(std, F.lit(0.0))


def flattened(nested: DataFrame, *, alpha: float = 0.0, threshold: float = MIN_SAVING) -> DataFrame:
    """One row for each candidate of ``nested(items ...)`` whose saving under one of the models reaches the threshold.

    Savings are z scores, ``alpha`` of them added for each key saved; what is missing counts 0.
    """
    rows = nested.select(F.explode("items").alias("i")).select("i.text", "i.type", "i.frequency", F.explode("i.candidates").alias("c"))
    part = lambda m, k: F.coalesce(F.col(f"c.savings.{m}.{k}"), F.lit(0.0))
    total = lambda m: part("keystrokes", "mean") * alpha + part(m, "mean")
    flat = rows.select(
        "text", "type", "frequency", "c.abbr", "c.trigger_form", F.coalesce("c.intuitiveness", F.lit(0.0)).alias("intuitiveness"), total("dl").alias("savings_z_dl"),
        total("lgbm").alias("savings_z_lgbm"), part("dl", "std").alias("savings_z_dl_std"), part("lgbm", "std").alias("savings_z_lgbm_std"),
        part("keystrokes", "mean").alias("savings_keystrokes"),
    )
    kept = flat.where(F.greatest("savings_z_dl", "savings_z_lgbm") >= threshold)
    return kept.withColumn("savings_z_mean", (F.col("savings_z_dl") + F.col("savings_z_lgbm")) / 2)


def eligible(df: DataFrame, *, words: bool = True, suffixes: bool = True, longest_suffix: int | None = None, repeat_key: bool = True) -> DataFrame:
    suffix = F.col("type") == "suffix"
    keep = F.lit(True)
    if not suffixes:
        keep = keep & ~suffix
    if not words:
        keep = keep & suffix
    if longest_suffix is not None:
        keep = keep & ~(suffix & (F.length("text") > longest_suffix))
    if repeat_key:
        double = (F.length("abbr") == 2) & (F.substring("abbr", 1, 1) == F.substring("abbr", 2, 1))
        keep = keep & ~(double & (F.col("trigger_form") == "trg"))
    return df.where(keep)


def linked(df: DataFrame, order: str) -> DataFrame:
    """Entries alike in text, abbreviation and form become one: the first one's values, all frequencies added, all types listed."""
    others = [c for c in df.columns if c not in ("text", "abbr", "trigger_form", "frequency", order)]
    return df.groupBy("text", "abbr", "trigger_form").agg(
        F.sum("frequency").alias("frequency"),
        *(F.min_by(c, order).alias(c) for c in others),
        F.transform(F.array_sort(F.collect_list(F.struct(order, "type"))), lambda s: s["type"]).alias("types"),
        (F.count("*") > 1).alias("is_linked"),
        F.min(order).alias(order),
    )


def short_list(df: DataFrame, mean: str, std: str, *, lambda_: float, sigma: float, k: int = 1, ties: tuple[str, ...] = ("abbr", "trigger_form")) -> DataFrame:
    """The k best entries of each text by the blend of saving and intuitiveness."""
    blend = (1 - lambda_) * effective(F.col(mean), F.col(std), sigma) + lambda_ * 10 * F.coalesce("intuitiveness", F.lit(0.0))
    ranked = df.withColumn("blend", blend)
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("blend"), *ties))).where(F.col("rn") <= k).drop("rn")


def keep_best(df: DataFrame, item: str, score: str, k: int, forms: tuple[str, ...], *ties: str) -> DataFrame:
    """The k best of an item, and besides them all with one of the forms."""
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc(score), *ties))
    return df.withColumn("rn", rank).where((F.col("rn") <= k) | F.col("trigger_form").isin(*forms)).drop("rn")


def overlaps(df: DataFrame, key: str, text: str = "text", kind: str = "type") -> DataFrame:
    """(i, j): entry i's text properly ends in the text of suffix entry j (the first one of that text)."""
    suffix = df.where(F.col(kind) == "suffix").groupBy(F.col(text).alias("end")).agg(F.min(key).alias("j"))
    ends = df.where(F.length(text) > 1).select(F.col(key).alias("i"), text, F.explode(F.sequence(F.lit(1), F.length(text) - 1)).alias("n"))
    return ends.select("i", F.right(text, F.col("n")).alias("end")).join(suffix, "end").where("i != j").select("i", "j")


@dataclass(frozen=True)
class Entry:
    text: str
    abbr: str
    form: str
    reward: int


def reward(frequency: float, speedup: float, intuitive: float, lambda_: float) -> int:
    """Speed and intuitiveness, blended and scaled; every part is cut to a whole number."""
    fast = int(frequency * speedup * SCALE)
    return int((1 - lambda_) * fast + lambda_ * int(intuitive * frequency * 10 * SCALE)) if lambda_ > 0 else fast


def value(chosen: set[int], entries: list[Entry], penalties: dict[tuple[int, int], int]) -> int:
    return sum(entries[i].reward for i in chosen) - sum(p for (i, j), p in penalties.items() if i in chosen and j in chosen)


#: Up to so many entries the best set is searched for exactly, and up to so many more every exchange is followed by filling up again.
EXACT, THOROUGH = 20, 2_000


def choose(entries: list[Entry], penalties: dict[tuple[int, int], int], size: int, rounds: int = 20) -> set[int]:
    """A set of at most ``size`` entries, no text and no (abbreviation, form) twice, of high reward less the penalties of pairs.

    The best gain first; then exchanges as long as they help: one entry comes in for those in its way, or for the one that
    is worth least, and what still fits fills up.
    """
    near: dict[int, dict[int, int]] = {}
    for (i, j), p in penalties.items():
        near.setdefault(i, {})[j] = near.get(i, {}).get(j, 0) + p
        near.setdefault(j, {})[i] = near.get(j, {}).get(i, 0) + p
    order = sorted(range(len(entries)), key=lambda i: (-entries[i].reward, i))

    def worth(i: int, chosen: set[int]) -> int:
        return entries[i].reward - sum(p for j, p in near.get(i, {}).items() if j in chosen and j != i)

    def filled(chosen: set[int]) -> set[int]:
        texts, abbrs = {entries[i].text for i in chosen}, {(entries[i].abbr, entries[i].form) for i in chosen}
        for i in order:
            if len(chosen) >= size:
                break
            e = entries[i]
            if i not in chosen and e.text not in texts and (e.abbr, e.form) not in abbrs and worth(i, chosen) > 0:
                chosen.add(i)
                texts.add(e.text)
                abbrs.add((e.abbr, e.form))
        return chosen

    def lost(out: set[int], rest: set[int]) -> int:
        """What a set is worth less without some of its entries."""
        within = sum(p for i in out for j, p in near.get(i, {}).items() if j in out) // 2
        return sum(worth(i, rest) for i in out) - within

    chosen = filled(set())
    total = value(chosen, entries, penalties)
    for _ in range(rounds):
        moved = False
        # In a full set no entry can replace another whose worth is above all of its reward.
        least = min((worth(j, chosen) for j in chosen), default=0) if len(chosen) >= size else 0
        for i in order:
            if entries[i].reward <= least:
                break
            if i in chosen:
                continue
            e = entries[i]
            rest = {j for j in chosen if entries[j].text != e.text and (entries[j].abbr, entries[j].form) != (e.abbr, e.form)}
            ways = [rest] if len(rest) < size else [rest - {min(rest, key=lambda j: (worth(j, rest), j))}] if rest else []
            if near.get(i):
                ways.append({j for j in ways[0] if j not in near[i]} if ways else set())
            for way in ways:
                now = total - lost(chosen - way, way) + worth(i, way)
                new = way | {i}
                if len(entries) <= THOROUGH:
                    new = filled(new)
                    now = value(new, entries, penalties)
                if now > total:
                    chosen, total, moved = new, now, True
                    break
        if not moved:
            break
    return chosen


def bound(entries: list[Entry], size: int) -> int:
    """What no set can be worth more than: the best rewards, one a text, without any other rule or penalty."""
    top: dict[str, int] = {}
    for e in entries:
        top[e.text] = max(top.get(e.text, 0), e.reward)
    return sum(heapq.nlargest(size, top.values()))


def best(entries: list[Entry], penalties: dict[tuple[int, int], int], size: int) -> set[int]:
    """The best set by branch and bound; for few entries only."""
    order = sorted(range(len(entries)), key=lambda i: (-entries[i].reward, i))
    rest = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        rest[k] = rest[k + 1] + max(0, entries[order[k]].reward)
    top: tuple[int, set[int]] = (0, set())

    def go(k: int, chosen: set[int], texts: set, abbrs: set, worth: int) -> None:
        nonlocal top
        if worth > top[0]:
            top = (worth, set(chosen))
        if k == len(order) or len(chosen) == size or worth + rest[k] <= top[0]:
            return
        i = order[k]
        e = entries[i]
        if e.text not in texts and (e.abbr, e.form) not in abbrs:
            cost = sum(p for (a, b), p in penalties.items() if (a == i and b in chosen) or (b == i and a in chosen))
            go(k + 1, chosen | {i}, texts | {e.text}, abbrs | {(e.abbr, e.form)}, worth + e.reward - cost)
        go(k + 1, chosen, texts, abbrs, worth)

    go(0, set(), set(), set(), 0)
    return top[1]


def optimise(
    df: DataFrame, *, mean: str = "savings_z_lgbm", std: str = "savings_z_lgbm_std", lambda_: float = 0.5, overlap: float = 1.0, sigma: float = 1.0, floor: float = 0.30,
    size: int = 160, mode: str = "all", per_text: int = 1, limit: int = 200_000,
) -> DataFrame:
    """The chosen entries of ``flattened`` rows, with savings_z_eff, and gap: by what share a better set may at most be above theirs.

    Spark makes the short list and the overlaps; the search, which is sequential, runs on the driver over at most ``limit`` entries.
    """
    listed = short_list(df, mean, std, lambda_=lambda_, sigma=sigma, k=per_text).withColumn("savings_z_eff", effective(F.col(mean), F.col(std), sigma))
    keep = (F.coalesce("intuitiveness", F.lit(0.0)) >= floor) & (F.col("savings_z_eff") > 0)
    if mode == "trg":
        keep = keep & (F.col("trigger_form") == "trg")
    elif mode == "doubletap":
        keep = keep & (F.col("trigger_form") == "doubletap") & (F.length("abbr") == 2) & (F.substring("abbr", 1, 1) == F.substring("abbr", 2, 1))
    order = Window.orderBy("text", "abbr", "trigger_form")
    numbered = listed.where(keep).withColumn("entry", F.row_number().over(order) - 1)
    rows = numbered.orderBy("entry").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} entries")
    entries = [Entry(r.text, r.abbr, r.trigger_form, reward(r.frequency, r.savings_z_eff, r.intuitiveness or 0.0, lambda_)) for r in rows]
    penalties = {}
    if overlap > 0:
        for r in overlaps(numbered, "entry").collect():
            penalties[r.i, r.j] = int(overlap * rows[r.i].frequency * (rows[r.j].savings_z_mean or 0.0) * SCALE)
    exact = len(entries) <= EXACT
    chosen = sorted((best if exact else choose)(entries, penalties, size))
    most = bound(entries, size)
    gap = 0.0 if exact or not most else 1 - value(set(chosen), entries, penalties) / most
    spark = df.sparkSession
    return numbered.withColumn("gap", F.lit(gap)).join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], "entry int")), "entry", "left_semi").drop("entry", "blend")


def sweep(df: DataFrame, lambdas: list[float], **params) -> DataFrame:
    """A row for each lambda: size, saving and mean intuitiveness of its dictionary, and the gap that its choice may leave."""
    out: DataFrame | None = None
    for value_ in lambdas:
        one = optimise(df, lambda_=value_, **params).agg(
            F.lit(value_).alias("lambda"), F.count("*").alias("size"), F.sum(F.col("frequency") * F.col("savings_z_mean")).alias("saving"), F.avg("intuitiveness").alias("intuitiveness"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap")
        )
        out = one if out is None else out.unionByName(one)
    return out
