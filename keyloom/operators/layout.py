"""Keyboards as small dimensions: slots with places and fingers, layouts, shifted characters, and what follows from them."""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots by row from the outer to the inner key, for each hand; x counts from the hand's own side, y from
# the home row. Each row: y, left keys, x of the first one, right keys, x of the first one (right ones count down).
ROWS = (
    (2, "12345", -0.75, "67890-=", 4.75),
    (1, "qwert", -0.25, "yuiop[]", 4.25),
    (0, "asdfg", 0.0, "hjkl;'", 4.0),
    (-1, "zxcvb", 0.5, "nm,./", 3.5),
)
LEFT_FINGERS, RIGHT_FINGERS = (0, 1, 2, 3, 3), (6, 6, 7, 8, 9, 9, 9)
SPACE = (" ", 3.5, -2.0, 4)
# Slots and the characters that each layout has on them, in the same order.
SLOTS = "1234567890-=qwertyuiop[]asdfghjkl;'zxcvbnm,./ "
SLOTS_44 = "1234567890qwertyuiop[]asdfghjkl;'zxcvbnm,./ "
LAYOUTS = {
    "qwerty": (SLOTS, SLOTS),
    "dvorak": (SLOTS_44, "1234567890',.pyfgcrl/=aoeuidhtns-;qjkxbmwvz "),
    "colemak": (SLOTS_44, "1234567890qwfpgjluy;[]arstdhneio'zxcvbkm,./ "),
    "colemakdh": (SLOTS_44, "1234567890qwfpbjluy;[]arstgmneio'zxcdvkh,./ "),
    "random": (SLOTS_44, "1234567890zxj/;pb=l'dwc,mvq-u.ryofesgthaikn "),
}
# Shifted characters of the keys that are no letters.
SHIFTED = dict(zip("1234567890-=[];',./", "!@#$%^&*()_+{}:\"<>?", strict=True))
#: The trigger key (left thumb's place) and the repeat key (right little finger's home place).
TRIGGER, REPEAT = "\x01", "\x02"
# The key on which a finger rests; the little finger's may be taken by the repeat key.
HOME = {0: "a", 1: "s", 2: "d", 3: "f", 4: " ", 5: " ", 6: "j", 7: "k", 8: "l", 9: ";"}


def slot_rows(repeat_key: bool = False) -> list[tuple[str, float, float, int]]:
    """(slot, x, y, finger); with ``repeat_key`` the repeat key has the place of ';' and the trigger key that of the space bar."""
    rows = [
        row
        for y, left, x_left, right, x_right in ROWS
        for row in chain(
            ((k, x_left + i, float(y), LEFT_FINGERS[i]) for i, k in enumerate(left)),
            ((k, x_right - i, float(y), RIGHT_FINGERS[i]) for i, k in enumerate(right)),
        )
    ] + [SPACE]
    if repeat_key:
        place = {r[0]: r for r in rows}
        rows = [r for r in rows if r[0] != ";"] + [(REPEAT, *place[";"][1:]), (TRIGGER, *SPACE[1:])]
    return rows


def layout_rows(name: str = "qwerty", repeat_key: bool = False) -> list[tuple[str, str]]:
    """(slot, keycode) of a layout."""
    slots, keys = LAYOUTS[name]
    pairs = list(zip(slots, keys, strict=True))
    return [p for p in pairs if p[0] != ";"] + [(REPEAT, REPEAT), (TRIGGER, TRIGGER)] if repeat_key else pairs


def shift_rows() -> list[tuple[str, str]]:
    """(base, shift)."""
    return [*SHIFTED.items(), *((c, c.upper()) for c in "abcdefghijklmnopqrstuvwxyz")]


def small(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows as a local relation, whose size the optimiser knows."""
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return spark.createDataFrame(pa.table({name: pa.array(v, kind) for (name, kind), v in zip(columns.items(), values, strict=True)}))


def dimensions(spark: SparkSession, name: str = "qwerty", repeat_key: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The layout, slot and shift tables; each is a few dozen rows."""
    return (
        small(spark, layout_rows(name, repeat_key), slot=pa.string(), keycode=pa.string()),
        small(spark, slot_rows(repeat_key), slot=pa.string(), x=pa.float64(), y=pa.float64(), finger=pa.int32()),
        small(spark, shift_rows(), base=pa.string(), shift=pa.string()),
    )


def hand_of(finger):
    """0 left, 1 right, 2 thumbs."""
    return F.when(finger < 4, 0).when(finger > 5, 1).when(finger.isNotNull(), 2)


def finger_type_of(finger):
    """The finger irrespective of the hand: 0 little finger to 4 thumb."""
    return F.when(finger >= 5, 9 - finger).otherwise(finger)


def key_dim(layout: DataFrame, slots: DataFrame, shifts: DataFrame) -> DataFrame:
    """(key_id, finger, finger_type, hand, x, y, shift, slot) for every character of one ASCII code; a shifted one has its base's key."""
    base = layout.where(F.length("keycode") == 1).join(slots, "slot").select("keycode", "slot", "x", "y", "finger", F.lit(0.0).alias("shift"))
    upper = shifts.join(base.drop("shift"), F.col("base") == F.col("keycode")).select(
        F.col("shift").alias("keycode"), F.lit(None).cast("string").alias("slot"), "x", "y", "finger", F.lit(1.0).alias("shift")
    )
    both = base.unionByName(upper).where(F.ascii("keycode") < 128)
    return both.select(
        F.ascii("keycode").alias("key_id"),
        "finger",
        finger_type_of(F.col("finger")).alias("finger_type"),
        hand_of(F.col("finger")).alias("hand"),
        "x",
        "y",
        "shift",
        "slot",
    )


def movement_dim(slots: DataFrame) -> DataFrame:
    """(slot_1, slot_2, move_dist, move_sin, move_cos): the way of the finger that presses the second key.

    On one finger it comes from the first key, else from its home place. No way at all is (0, null, null).
    """
    home = {f: k for f, k in HOME.items()}
    homes = slots.select(F.col("finger").alias("hf"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("slot").alias("hs"))
    is_home = F.lit(False)
    for finger, key in home.items():
        is_home = is_home | ((F.col("hf") == finger) & F.col("hs").isin(key, REPEAT) if finger == 9 else (F.col("hf") == finger) & (F.col("hs") == key))
    homes = homes.where(is_home).drop("hs")
    one = slots.select(F.col("slot").alias("slot_1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("finger").alias("f1"))
    two = slots.join(homes, F.col("finger") == F.col("hf"), "left").select(F.col("slot").alias("slot_2"), "x", "y", F.col("finger").alias("f2"), "hx", "hy")
    same = F.col("f1") == F.col("f2")
    # Both sides are the slots of one keyboard: a few dozen rows.
    pairs = one.crossJoin(F.broadcast(two)).select(
        "slot_1", "slot_2", (F.col("x") - F.when(same, F.col("x1")).otherwise(F.col("hx"))).alias("dx"), (F.col("y") - F.when(same, F.col("y1")).otherwise(F.col("hy"))).alias("dy")
    )
    dist = F.coalesce(F.hypot("dx", "dy"), F.lit(0.0))
    angle = F.when(dist > 0, F.atan2("dy", "dx"))
    return pairs.select("slot_1", "slot_2", dist.alias("move_dist"), F.sin(angle).alias("move_sin"), F.cos(angle).alias("move_cos"))


def reach_dim(slots: DataFrame) -> DataFrame:
    """(slot, move_dist, move_sin, move_cos): the way to each key from its finger's home place."""
    ways = movement_dim(slots)
    fingers = slots.select("slot", "finger")
    homes = [(f, k) for f, k in HOME.items()] + [(9, REPEAT)]
    table = small(slots.sparkSession, homes, finger=pa.int32(), home=pa.string())
    here = table.join(slots.select(F.col("slot").alias("home")), "home")
    return ways.join(F.broadcast(fingers.join(here, "finger").select(F.col("slot").alias("slot_2"), F.col("home").alias("slot_1"))), ["slot_1", "slot_2"]).select(
        F.col("slot_2").alias("slot"), "move_dist", "move_sin", "move_cos"
    )


def drawing(slots: DataFrame) -> DataFrame:
    """Where a picture of the keyboard has each key: the right hand mirrored, so that x runs from left to right."""
    right = F.col("finger") > 5
    return slots.select("slot", F.when(right, 9 - F.col("x")).otherwise(F.col("x")).alias("px"), F.col("y").alias("py"), finger_type_of(F.col("finger")).alias("colour"))


