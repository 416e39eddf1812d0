"""Sources and sinks: tables written to the shared folder in each format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, session
from ..operators.abbreviations.selection import flattened
from ..operators.sequences import characters
from ..sources import sinks, tables
from ..sources.tables import table
from .base import query


def _place(spark: SparkSession, name: str) -> str:
    return f"{session.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::VARCHAR AS PARTICIPANT_ID, n_name AS LAYOUT, n_regionkey::BIGINT AS WPM FROM nation WHERE n_name IS NOT NULL")
def participants_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants as TSV with a header, and back."""
    path, columns = _place(spark, "participants"), "PARTICIPANT_ID string, LAYOUT string, WPM long"
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("PARTICIPANT_ID"), F.col("n_name").alias("LAYOUT"), F.col("n_regionkey").cast("long").alias("WPM"))
    sinks.tsv(rows, path)
    return tables.participants(spark, path, columns).where("LAYOUT IS NOT NULL")


@query("""WITH k AS (SELECT item_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS c FROM benchmark WHERE item_id <= 10 AND length(text) > 0)
SELECT item_id::VARCHAR AS PARTICIPANT_ID, '1' AS TEST_SECTION_ID, (pos * 100)::BIGINT AS PRESS_TIME, c AS LETTER FROM k WHERE c NOT IN (' ', chr(9), chr(10), chr(13), chr(92)) AND ascii(c) BETWEEN 33 AND 126""")
def key_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key logs, one file for each participant, and back with the participant from the file's name."""
    path = _place(spark, "logs")
    keys = characters(table(spark, sf_dir, "benchmark").where("item_id <= 10"), "text", "item_id").where((F.col("key_id") > 32) & (F.col("key_id") < 127) & (F.col("key") != "\\"))
    lines = keys.select("item_id", F.concat_ws("\t", F.lit("1"), F.lit("a sentence"), (F.col("pos") * 100).cast("string"), "key").alias("line"), F.col("pos"))
    whole = lines.groupBy("item_id").agg(F.concat_ws("\n", F.lit("TEST_SECTION_ID\tSENTENCE\tPRESS_TIME\tLETTER"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("value"))
    session.write_files(whole.select(F.concat(F.col("item_id").cast("string"), F.lit("_keystrokes.txt")).alias("name"), "value"), path)
    wanted = tables.participants_from_files(spark, path)
    return tables.keystrokes(spark, path, wanted).select("PARTICIPANT_ID", "TEST_SECTION_ID", "PRESS_TIME", "LETTER")


@query("SELECT r_name AS item, r_regionkey::DOUBLE AS value FROM region")
def json_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map as one JSON document, and back."""
    path = _place(spark, "map")
    sinks.as_map(table(spark, sf_dir, "region").withColumn("v", F.col("r_regionkey").cast("double")), "r_name", "v").select(F.col("json").alias("value")).coalesce(1).write.text(path)
    return tables.frequency_map(spark, path)


@query("""SELECT p_name AS text, 'singleword' AS type, p_partkey::BIGINT AS frequency, left(p_name, 2) AS abbr, 'trg' AS trigger_form, 0.5::DOUBLE AS intuitiveness, (p_size / 10.0)::DOUBLE AS savings_z_dl,
 0.0::DOUBLE AS savings_z_lgbm, (p_size / 20.0)::DOUBLE AS savings_z_mean FROM part WHERE p_partkey <= 50 AND p_size / 10.0 >= 0.25""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their candidates gathered into nested documents, written as JSON lines, read and flattened again."""
    path = _place(spark, "nested")
    none = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"))
    savings = F.struct(F.struct((F.col("p_size") / 10.0).alias("mean"), F.lit(0.0).alias("std")).alias("dl"), none.alias("lgbm"), none.alias("keystrokes"))
    rows = table(spark, sf_dir, "part").where("p_partkey <= 50").select(
        F.col("p_name").alias("text"), F.lit("singleword").alias("type"), F.col("p_partkey").cast("long").alias("frequency"), F.left("p_name", F.lit(2)).alias("abbr"),
        F.lit("trg").alias("trigger_form"), F.lit(0.5).alias("intuitiveness"), savings.alias("savings"),
    )
    items = sinks.nested(rows, ["text", "type", "frequency"], ["abbr", "trigger_form", "intuitiveness", "savings"], "candidates")
    sinks.json_lines(items.select(F.array(F.struct("text", "type", "frequency", "candidates")).alias("items")), path)
    flat = flattened(tables.nested_candidates(spark, path, lines=True))
    return flat.select("text", "type", "frequency", "abbr", "trigger_form", "intuitiveness", "savings_z_dl", "savings_z_lgbm", "savings_z_mean")


@query("SELECT (r_regionkey / 4.0)::DOUBLE AS lambda, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def numbered_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of results for each value of a parameter, read together with the value from the file's name."""
    path = _place(spark, "sweep")
    rows = table(spark, sf_dir, "nation").select((F.col("n_regionkey") / 4.0).alias("l"), F.to_json(F.struct("n_nationkey")).alias("line"))
    files = rows.groupBy("l").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("value"))
    session.write_files(files.select(F.concat(F.lit("dict_lambda_"), F.col("l").cast("string"), F.lit(".json")).alias("name"), "value"), path)
    read = spark.read.schema("n_nationkey long").json(f"{path}/dict_lambda_*.json")
    return tables.numbered_files(read, r"dict_lambda_([0-9.]+)\.json$").select("lambda", "n_nationkey")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def parquet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in partitioned files of bounded length, unfinished parts written again, and back."""
    path = _place(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.parquet(orders, f"{path}/all", by=("o_orderstatus",), rows_a_file=10_000)
    sinks.resume(spark, {f"{path}/all": orders, f"{path}/none": orders.limit(0)})
    read = spark.read.schema(orders.schema).parquet(f"{path}/all").unionByName(spark.read.schema(orders.schema).parquet(f"{path}/none"))
    return read.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT 'p' || user_id AS participant_id, 's' || event_id AS sequence_id, NULL::VARCHAR AS original_sequence_id, left(event_type, 1) AS key, (event_id * 10)::BIGINT AS time,
 event_type = 'error' AS is_typo, NULL::VARCHAR AS typo_type FROM events""")
def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events projected onto the columns of a key sequence: cast, missing ones null, further ones gone."""
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), "user_id").alias("participant_id"), F.concat(F.lit("s"), "event_id").alias("sequence_id"), F.left("event_type", F.lit(1)).alias("key"),
        (F.col("event_id") * 10).cast("string").alias("time"), (F.col("event_type") == "error").alias("is_typo"), "value", "props",
    )
    return schema.conform(rows, schema.SEQUENCE)
