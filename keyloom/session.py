"""Spark session for local work; on a cluster the session comes from outside."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all is local one of this machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (configured or f"{tempfile.gettempdir()}/keyloom-{spark.sparkContext.applicationId}").rstrip("/")


def write_files(files: DataFrame, path: str) -> None:
    """A file of its own in a folder for each row (name, value), written by the tasks through Spark's file systems."""
    spark = files.sparkSession
    temporary = f"{path}.parts"
    files.write.partitionBy("name").option("lineSep", "\n").text(temporary)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(path))
    for folder in system.listStatus(hadoop.Path(temporary)):
        name = folder.getPath().getName()
        if name.startswith("name="):
            (part,) = [f.getPath() for f in system.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            system.rename(part, hadoop.Path(path, name.removeprefix("name=")))
    system.delete(hadoop.Path(temporary), True)


def local(cpus: int | None = None, memory: str = "8g", **more: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("keyloom").config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(cpus)} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
