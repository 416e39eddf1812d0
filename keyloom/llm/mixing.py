"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; a document's expected copies are its source's target over its source's
size. The expected copies are prefix-summed within the source, one random offset is added, and a document is emitted
once for each integer boundary that its interval crosses, so it comes floor or ceil of the expected number of times. The
offset is a hash of the source, so reruns agree. Documents stand in hashed buckets, by size within and up and down by
turns, so what is taken stays near the target for any offset.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null id is an id like
another; repeated rows are separate documents; an empty table gives an empty result; a source without words has target
0 and nothing is taken from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint, documents, stored, whole_rows

#: Words of a text; all other characters part them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one window partition holds, about; sources with more are numbered in several.
BUCKET_ROWS = 4_000
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Parts into which the rows of a source fall when they are joined with its target.
SALTS = 64
MAX_REPEAT = 3
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bits(key: Column) -> Column:
    """A draw: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size): the mixture's words by weight, none above ``max_repeat`` times its source.

    Sources in ascending order of limit over weight fill up first; the first one that its weighted share of the rest does
    not fill fixes that share for itself and all after it.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    limited = weighted.withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    shares = limited.withColumn("share", (F.sum("source_size").over(whole) - filled) / rest).withColumn("rn", F.row_number().over(order))
    fixed = shares.withColumn("fixed", F.min(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.struct("rn", "share"))).over(whole)["share"])
    return fixed.select("source", "source_size", "source_docs", F.least(F.col("cap").cast("double"), F.col("fixed") * F.col("w")).alias("target"))


def mix(
    sizes: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    bucket_rows: int = BUCKET_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(key, doc_id, source, size) -> the same with source_size, target and copies.

    Rows are numbered within their source by (bucket, size, id, key); the buckets, dealt by a hash of the id (of the key
    where it is null), keep a window partition small however large the source is.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    buckets = F.ceil(F.col("source_docs") / bucket_rows).alias("buckets")
    goal = targets(sizes, weights, max_repeat).select(F.col("source").alias("g"), "source_size", "target", rate, buckets)
    # A source may hold most rows, so each has a row in ``goal`` for every salt.
    goal = goal.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    draw = _bits(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.col("key")))))
    dealt = sizes.withColumn("salted", salt).join(goal, F.col("source").eqNullSafe(F.col("g")) & (F.col("salted") == F.col("salt"))).withColumn("bucket", draw % F.col("buckets")).drop("g", "salt", "salted", "buckets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start")
    )
    # Every other bucket is in descending order, so that what one bucket takes too much the next takes too little.
    snake = F.when(F.col("bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    inner = Window.partitionBy("source", "bucket").orderBy(snake, "doc_id", "key")
    ranked = dealt.withColumn("rn", F.row_number().over(inner)).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    offset = _bits(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("")))).cast("double") / F.lit(4294967296.0)
    crossed = lambda n: F.floor(n * F.col("rate") + F.col("u"))
    copies = F.least(crossed(F.col("place")) - crossed(F.col("place") - 1), F.lit(max_repeat)).cast("long")
    placed = ranked.withColumn("place", F.col("start") + F.col("rn")).withColumn("u", offset)
    return placed.select("key", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def _sizes(docs: DataFrame, text: Column, doc_id: Column, source: Column, key: Column) -> DataFrame:
    return docs.select(key.alias("key"), doc_id.alias("doc_id"), source.alias("source"), word_count(text).alias("size"))


def mix_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **params) -> DataFrame:
    """The mixture itself: each row as often as it is taken, all columns kept, whatever their names.

    Rows are numbered and stored once, as a second scan need not number them alike once the cluster has changed.
    """
    keyed = stored(docs.select(whole_rows(), F.monotonically_increasing_id().alias("__key")), "keyed")
    doc = F.col("__doc")
    taken = mix(checkpoint(_sizes(keyed, doc[text_col], doc[id_col], doc[source_col], F.col("__key"))), **params).where("copies > 0")
    joined = keyed.join(taken.select(F.col("key").alias("__key"), F.col("copies").alias("__copies")), "__key")
    return joined.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select("__doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sizes = checkpoint(_sizes(docs, F.col("text"), F.col("doc_id"), F.col("source"), F.monotonically_increasing_id()))
    mixed = mix(sizes)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast(T.LongType()).alias("taken"))


ORACLE = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substring(md5('7:' || doc_id), 1, 8))::BIGINT % ((count(*) OVER (PARTITION BY source) + 3999) // 4000) AS bucket
  FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
wt AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM tot),
sh AS (
  SELECT *, ((SELECT sum(source_size) FROM tot) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM wt),
fx AS (SELECT arg_min(share, cap / w) AS fixed FROM sh WHERE share * w <= cap),
goal AS (
  SELECT source, source_size, least(cap::DOUBLE, fixed * w) AS target,
         CASE WHEN source_size > 0 THEN least(cap::DOUBLE, fixed * w) / source_size ELSE 0.0 END AS rate,
         ('0x' || substring(md5('7/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM sh, fx),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, doc_id) AS place FROM docs)
SELECT doc_id, size, source_size, target,
       (least(floor(place * rate + u)::BIGINT - floor((place - 1) * rate + u)::BIGINT, 3) * size)::BIGINT AS taken
FROM ranked JOIN goal ON ranked.source IS NOT DISTINCT FROM goal.source
"""
