"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): neighbours are linked to the smallest node near u, the larger ones or the smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(low, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)``; root is the component's smallest node and has a row itself.

    Self-loops and repeated edges do no harm; an empty table gives an empty result. Each round is written to the shared
    checkpoint folder, and the hub of a star is only ever reduced to a minimum, never gathered.
    """
    now, seen = checkpoint(edges.where("u != v").distinct()), None
    for _ in range(max_steps):
        now = checkpoint(_stars(_stars(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
