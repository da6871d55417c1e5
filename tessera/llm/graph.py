"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); the root is the smallest node.

    Each round points larger neighbours, then smaller ones, at the smallest
    known node; the edges become stars in a logarithmic number of rounds. Every
    round is written to the shared folder. It ends when every node has either
    one smaller neighbour or only larger ones.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "cc")
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low).distinct(), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("int").alias("up"),
                     F.lit(c == "v").cast("int").alias("down")) for c in ("u", "v")]
    roles = edges.select(F.explode(F.array(*ends)).alias("e")).groupBy("e.node").agg(
        F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return roles.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0
