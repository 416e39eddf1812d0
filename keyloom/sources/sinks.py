"""Writers: TSV, Parquet in bounded files, JSON documents and maps, and marks of finished parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, *, by: tuple[str, ...] = (), rows_a_file: int = 0) -> None:
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_map(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row, json: an object of key and value, by descending value; for dimensions, as it is one document."""
    entry = F.struct((-F.col(order or value)).alias("o"), F.col(key).alias("k"), F.col(value).alias("v"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["k"], e["v"]))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def nested(df: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows gathered into an array of structs for each group, as the nested documents have them."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def document(meta: DataFrame, entries: DataFrame, name: str = "dictionary") -> DataFrame:
    """One row: metadata and all entries, for dictionaries of bounded size."""
    listed = entries.agg(F.collect_list(F.struct(*entries.columns)).alias(name))
    return meta.select(F.struct(*meta.columns).alias("metadata")).crossJoin(listed)


def finished(spark, path: str) -> bool:
    """Whether a part was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def resume(spark, parts: dict[str, DataFrame]) -> list[str]:
    """Write the parts that are not there yet; their paths."""
    todo = [p for p in parts if not finished(spark, p)]
    for p in todo:
        parts[p].write.mode("overwrite").parquet(p)
    return todo
