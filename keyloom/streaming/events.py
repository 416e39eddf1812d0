"""The same sequence steps over event streams: ingest, live intervals by state, sessions, windows with late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read(spark: SparkSession, directory: str, schema: T.StructType = EVENTS, files: int = 1, glob: str = "*.parquet") -> DataFrame:
    """Files of a folder as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(directory)


def drain(df: DataFrame, checkpoint: str, write, mode: str = "append") -> None:
    """Process all that is there and stop; ``write(batch, number)`` gets each batch and must bear repetition of a number."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def to_parquet(path: str):
    """A batch writer whose repetition overwrites what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def timed(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    return df.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def windows(df: DataFrame, size: str = "1 hour", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding window; events behind the watermark fall out."""
    at = F.window("at", size, step) if step else F.window("at", size)
    return timed(df, late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): a user's events without a pause of ``gap``."""
    grouped = timed(df, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


INTERVALS = "user_id long, event_id long, iki long"


def _live(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
    before = rows["us"].shift(1)
    if last is not None and len(rows):
        before.iloc[0] = last
    state.update((int(rows["us"].iloc[-1]),))
    iki = (rows["us"] - before).astype("Int64")
    yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "iki": iki})


def live_intervals(df: DataFrame) -> DataFrame:
    """Microseconds since the user's last event, across batches; the state is one number a user."""
    rows = df.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(_live, INTERVALS, "last long", "append", GroupStateTimeout.NoTimeout)
