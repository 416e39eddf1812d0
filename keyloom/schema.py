"""Schemas of the sources, and projection onto a fixed column list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYSTROKES = "PARTICIPANT_ID string, TEST_SECTION_ID string, SENTENCE string, PRESS_TIME long, LETTER string"
SEQUENCE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("participant_id", "sequence_id", "original_sequence_id", "key")]
    + [T.StructField("time", T.LongType()), T.StructField("is_typo", T.BooleanType()), T.StructField("typo_type", T.StringType())]
)
LAYOUT_MAP = "slot string, x double, y double, finger int"
LAYOUT = "slot string, keycode string"
SHIFTS = "base string, shift string"
SAVING = "struct<mean:double,std:double>"
CANDIDATES = (
    "items array<struct<text:string,type:string,frequency:long,candidates:array<struct<abbr:string,trigger_form:string,"
    f"intuitiveness:double,savings:struct<dl:{SAVING},lgbm:{SAVING},keystrokes:{SAVING}>>>>>"
)
TRIALS = "study string, trial long, started timestamp, state string, value double"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in order, cast; those that the frame lacks are null, further ones go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
