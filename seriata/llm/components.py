"""Connected components by alternating large-star and small-star, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.llm.common import join_hot, materialize

FEW_EDGES = 200_000  # some MB: one task may get them all


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
    return join_hot(both.where("v > u"), least, ["u"], "deg", 2 * n, few=FEW_EDGES).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    moved = join_hot(down, least, ["u"], "deg", n, few=FEW_EDGES).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge down at most and no root has any: then both operations change nothing."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    odd = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)")
    return not odd.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): the least node reachable, for every node with an edge to another. Nulls link nothing; each round is written to the shared folder in the place of the one before. A node with a third of all edges does not meet them in one task."""
    e = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while not _stars(e):
        e = materialize(_large_star(e, e.count()), "components", instead_of=e)
        e = materialize(_small_star(e, e.count()), "components", instead_of=e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
