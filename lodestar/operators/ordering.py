"""Order of passages in the prompt, and the character budget.

Every strategy takes hits(query_id, chunk_id, doc_id, position, score, rank) and
returns them with ``rank`` set to the new place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(*order):
    return Window.partitionBy("query_id").orderBy(*order)


def edges(hits: DataFrame) -> DataFrame:
    """Best first and last, weakest in the middle: 1, 3, 5, ... 6, 4, 2 of the incoming order."""
    r = F.row_number().over(_by("rank"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    placed = hits.withColumn("__r", r).withColumn("__n", n)
    half = F.call_function("div", F.col("__r"), F.lit(2)).cast("int")
    new = F.when(F.col("__r") % 2 == 1, half + 1).otherwise(F.col("__n").cast("int") - half + 1)
    return placed.withColumn("rank", F.when(F.col("__n") <= 2, F.col("rank")).otherwise(new).cast("int")).drop("__r", "__n")


def descending(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_by(F.col("score").desc(), F.col("rank").asc())))


def ascending(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_by(F.col("score").asc(), F.col("rank").asc())))


def by_document(hits: DataFrame) -> DataFrame:
    """Documents by their best score, passages of one in text order."""
    w = Window.partitionBy("query_id", "doc_id")
    best = hits.withColumn("__best", F.max("score").over(w)).withColumn("__first", F.min("rank").over(w))
    order = _by(F.col("__best").desc(), F.col("__first").asc(), F.col("position").asc(), F.col("rank").asc())
    return best.withColumn("rank", F.row_number().over(order)).drop("__best", "__first")


STRATEGIES = {"edges": edges, "descending": descending, "ascending": ascending, "document": by_document}


def reorder(hits: DataFrame, strategy: str = "edges") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown ordering {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](hits)


def within_budget(hits: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Best hits until the next would pass the budget; the first always stays.

    Needs ``text``. Apply before reordering.
    """
    order = _by(F.col("score").desc(), F.col("rank").asc())
    used = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = hits.withColumn("__used", used).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("__used") <= max_chars) | (F.col("rank") == 1)).drop("__used")


def explain(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, chunk_id, old_rank, new_rank)."""
    return before.select("query_id", "chunk_id", F.col("rank").alias("old_rank")).join(
        after.select("query_id", "chunk_id", F.col("rank").alias("new_rank")), ["query_id", "chunk_id"]
    )
