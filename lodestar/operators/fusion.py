"""Fusion of rankings kept as long tables: hits(query_id, ranker_id, chunk_id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def stack(*rankings: DataFrame) -> DataFrame:
    """Rankings one under the other, numbered from 0 in their order."""
    named = [r.withColumn("ranker_id", F.lit(i)) for i, r in enumerate(rankings)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _ranked(df: DataFrame, k: int | None, *ties) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    out = df.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def reciprocal_rank_fusion(hits: DataFrame, k: int = 60, top_k: int | None = 10, weights: list[float] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): sum of w / (k + rank), ties by first appearance.

    A chunk that repeats in one ranking adds each time. Weights go to a query's
    non-empty rankings in order; every query must have as many of those as weights.
    """
    if weights is not None:
        places = hits.select("query_id", "ranker_id").distinct().withColumn(
            "w_at", F.row_number().over(Window.partitionBy("query_id").orderBy("ranker_id"))
        )
        sizes = places.groupBy("query_id").agg(F.max("w_at").alias("n")).filter(F.col("n") != len(weights))
        if sizes.limit(1).count():
            raise ValueError(f"{len(weights)} weights do not fit the number of rankings")
        table = F.array(*[F.lit(float(w)) for w in weights])
        hits = hits.join(places, ["query_id", "ranker_id"]).withColumn("w", F.get(table, F.col("w_at") - 1))
    else:
        hits = hits.withColumn("w", F.lit(1.0))
    fused = hits.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("w") / (F.lit(k) + F.col("rank"))), 12).alias("score"), F.min(F.struct("ranker_id", "rank")).alias("seen")
    )
    return _ranked(fused, top_k, F.col("seen").asc()).select("query_id", "chunk_id", "score", "rank")


def min_max(hits: DataFrame) -> DataFrame:
    """hits with scores scaled to [0, 1] per query and ranking; 1.0 when all are equal."""
    w = Window.partitionBy("query_id", "ranker_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def weighted_sum(dense: DataFrame, lexical: DataFrame, dense_weight: float = 0.5, top_k: int | None = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): w * dense + (1 - w) * lexical after scaling; missing is 0."""
    if not 0 <= dense_weight <= 1:
        raise ValueError("dense_weight must lie in [0, 1]")
    scaled = min_max(stack(dense, lexical))
    mixed = scaled.groupBy("query_id", "chunk_id").agg(
        F.round(
            F.sum(F.when(F.col("ranker_id") == 0, F.col("score") * dense_weight).otherwise(F.col("score") * (1 - dense_weight))), DIGITS
        ).alias("score"),
        F.min(F.struct("ranker_id", "rank")).alias("seen"),
    )
    return _ranked(mixed, top_k, F.col("seen").asc()).select("query_id", "chunk_id", "score", "rank")


def deduplicate(hits: DataFrame) -> DataFrame:
    """The first hit of each chunk, renumbered in the order it came."""
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))
    kept = hits.withColumn("__n", first).filter("__n = 1").drop("__n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
