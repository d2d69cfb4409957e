"""Connected components by alternating large-star and small-star rounds.

Each round is a map-side-combined minimum and a join, so a node with very many
edges is an ordinary skewed join that adaptive execution may split, never a
group gathered in one task. Each round is written to the shared folder and the one
before it removed; the rounds end when the edges form stars, which one aggregation
tells. Their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, files_for

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("u"))
    down = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, which points to none."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not sums.filter((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).limit(1).count()


def components(edges: DataFrame, scratch: Scratch, name: str = "roots", a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node.

    Empty input gives an empty result; loops and repeated edges are ignored. The
    result reads the tables of ``scratch`` whose names begin with ``name``.
    """
    first = (
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    now = scratch.cut(first, f"{name}_0")
    files = files_for(now.sparkSession, 2 * now.count())  # a round adds no more than the nodes
    for turn in range(1, MAX_ROUNDS):
        if _settled(now):
            break
        now = scratch.cut(_small_star(_large_star(now)), f"{name}_{turn}", files)
        scratch.drop(f"{name}_{turn - 1}")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
