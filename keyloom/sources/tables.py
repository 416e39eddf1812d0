"""Readers: key logs, participants, corpora, dimensions and maps in JSON, nested candidate files, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_sentences, is_header, is_spam
from ..operators.sampling import first_rows
from ..schema import CANDIDATES, KEYSTROKES, LAYOUT, LAYOUT_MAP, SHIFTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan has fewer partitions than there are cores; a large input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, spread before their texts are taken apart."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def participants(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def keystrokes(spark: SparkSession, directory: str, wanted: DataFrame | None = None, id_col: str = "PARTICIPANT_ID", suffix: str = "_keystrokes.txt") -> DataFrame:
    """One file for each participant, without quotes; broken lines are left out. ``wanted`` restricts the participants."""
    reader = spark.read.schema(KEYSTROKES.replace("PARTICIPANT_ID string, ", "")).option("sep", "\t").option("header", True)
    rows = reader.option("quote", "").option("escape", "\\").option("mode", "DROPMALFORMED").csv(f"{directory}/*{suffix}")
    named = rows.withColumn("PARTICIPANT_ID", F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix}$", 1))
    return named if wanted is None else named.join(wanted.select(F.col(id_col).cast("string").alias("PARTICIPANT_ID")).distinct(), "PARTICIPANT_ID", "left_semi")


def participants_from_files(spark: SparkSession, directory: str, suffix: str = "_keystrokes.txt") -> DataFrame:
    """The ids in the file names of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]+){suffix}$", 1).alias("PARTICIPANT_ID"))


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def layout_files(spark: SparkSession, layout: str, slots: str, shifts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return dimension(spark, layout, LAYOUT), dimension(spark, slots, LAYOUT_MAP), dimension(spark, shifts, SHIFTS)


def frequency_map(spark: SparkSession, path: str) -> DataFrame:
    """(item, value) of a JSON object of numbers; a file that is not there or broken gives none."""
    empty = spark.createDataFrame([], "item string, value double")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return maps.where("m IS NOT NULL").select(F.explode("m").alias("item", "value"))


def nested_candidates(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(CANDIDATES).option("multiLine", not lines).json(path)


def numbered_files(df: DataFrame, pattern: str) -> DataFrame:
    """lambda: the number in the name of the file that a row came from, as ``pattern``'s group; other files' rows go."""
    return df.withColumn("lambda", F.regexp_extract(F.input_file_name(), pattern, 1)).where(F.col("lambda") != "").withColumn("lambda", F.col("lambda").cast("double"))


def trials_jdbc(spark: SparkSession, url: str, query: str) -> DataFrame:
    """Trials of a study store, where its JDBC driver is at hand."""
    return spark.read.format("jdbc").option("url", url).option("query", query).load()


# Tables and columns of a study store in SQLite, and how it numbers directions and states.
STUDY_SQL = """SELECT s.study_name AS study, t.number AS trial, t.datetime_start AS started, t.state AS state, v.value AS value
FROM trials t JOIN studies s ON s.study_id = t.study_id LEFT JOIN trial_values v ON v.trial_id = t.trial_id AND v.objective = 0"""


def trials_sqlite(spark: SparkSession, path: str, studies: tuple[str, ...] = ()) -> DataFrame:
    """Trials (schema.TRIALS) of a study store in one SQLite file, read by the driver, as it is a file of one machine."""
    import sqlite3

    store = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        rows = store.execute(STUDY_SQL).fetchall()
    finally:
        store.close()
    frame = spark.createDataFrame(rows, "study string, trial long, started string, state string, value double")
    chosen = frame.where(F.col("study").isin(*studies)) if studies else frame
    return chosen.withColumn("started", F.to_timestamp("started"))


def recent_sentences(df: DataFrame, text: str, created: str, since: Column, file: str, per_file: int, *order: str) -> DataFrame:
    """Clean sentences of posts since a date that are no spam, the first ones of each file. The date reaches the scan."""
    recent = df.where(F.col(created).isNotNull() & (F.col(created) >= since)).where(~is_spam(F.col(text)))
    return first_rows(clean_sentences(recent, text, file, *order), file, per_file, *order, "idx").drop("rn")


def article_sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return clean_sentences(df.where(~is_header(F.col(text))), text, *keep)


def preferred_source(df: DataFrame, source: str, value: str) -> DataFrame:
    """Rows of one source, if there is such a column; else all."""
    return df.where(F.col(source) == value) if source in df.columns else df


def filtered_participants(df: DataFrame, *, equal: dict[str, object] | None = None, above: tuple[str, float] | None = None, required: tuple[str, ...] = (), n: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that meet every condition given; empty values and ``any`` are no condition. The speed must be above its limit, not at it."""
    out = df.na.drop(subset=list(required)) if required else df
    for name, value in (equal or {}).items():
        if value not in (None, "", "any"):
            out = out.where(F.col(name) == value)
    if above and above[1]:
        out = out.where(F.col(above[0]) > above[1])
    if n:
        out = (out.orderBy(order) if order else out).limit(n)
    return out
