"""Reranking and the relevance filter, from model replies.

Replies come from a provider or from a table, so the ranking itself is a plan
without model calls. Hits are (query_id, chunk_id, text, score, rank, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import replies
from lodestar.session import written
from lodestar.sources.providers import ChatProvider, LocalChat, ask

POINTWISE_CHARS, LISTWISE_CHARS = 1500, 700


def _ordered(*order):
    return Window.partitionBy("query_id").orderBy(*order)


def pointwise_replies(hits: DataFrame, queries: DataFrame, provider: ChatProvider | None = None) -> DataFrame:
    """hits with ``reply``: one call a passage."""
    asked = hits.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    prompt = F.concat(F.col("question"), F.lit("\x1e"), F.substring("text", 1, POINTWISE_CHARS))
    return asked.withColumn("reply", ask(provider or LocalChat(), "grade", prompt, 0.0, 8)).drop("question")


def pointwise(replied: DataFrame, top_k: int = 4) -> DataFrame:
    """By grade, then by the score before; an unreadable grade counts as 5."""
    graded = replied.withColumn("grade", F.coalesce(replies.grade(F.col("reply")), F.lit(replies.DEFAULT_GRADE)))
    order = _ordered(F.col("grade").desc(), F.col("score").desc(), F.col("rank").asc())
    out = graded.withColumn("rank", F.row_number().over(order)).withColumn("score", F.col("grade") / 10)
    return out.filter(F.col("rank") <= top_k).drop("reply")


def listwise_replies(hits: DataFrame, queries: DataFrame, provider: ChatProvider | None = None) -> DataFrame:
    """(query_id, reply): one call a query over all its passages."""
    listed = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, LISTWISE_CHARS).alias("t")))), lambda x: x["t"]),
            "\x1d",
        ).alias("passages")
    )
    asked = listed.join(queries.select("query_id", "text"), "query_id")
    prompt = F.concat(F.col("text"), F.lit("\x1e"), F.col("passages"))
    return asked.select("query_id", ask(provider or LocalChat(), "listwise", prompt, 0.0, 100).alias("reply"))


def listwise(hits: DataFrame, replied: DataFrame, top_k: int = 4) -> DataFrame:
    """In the order that the reply names; scores stay. A failed call keeps the order."""
    placed = hits.withColumn("__at", F.row_number().over(_ordered("rank")))
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    order = counts.join(replied, "query_id", "left").select(
        "query_id", F.posexplode(replies.listed_order(F.when(F.col("n") > 1, F.col("reply")), F.col("n"))).alias("new", "__at")
    )
    out = placed.join(order, ["query_id", "__at"]).withColumn("rank", F.col("new") + 1)
    return out.filter(F.col("rank") <= top_k).drop("__at", "new")


def relevance_replies(hits: DataFrame, queries: DataFrame, provider: ChatProvider | None = None) -> DataFrame:
    asked = hits.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    prompt = F.concat(F.col("question"), F.lit("\x1e"), F.substring("text", 1, POINTWISE_CHARS))
    return asked.withColumn("reply", ask(provider or LocalChat(), "relevant", prompt, 0.0, 20)).drop("question")


def relevance_filter(replied: DataFrame) -> DataFrame:
    """hits with ``kept``: survivors are renumbered; if none survives all stay as they were."""
    judged = replied.withColumn("verdict", replies.is_relevant(F.col("reply")))
    any_kept = F.max("verdict").over(Window.partitionBy("query_id"))
    out = judged.withColumn("any_kept", any_kept)
    place = F.row_number().over(Window.partitionBy("query_id", "verdict").orderBy("rank"))
    return (
        out.withColumn("__new", place)
        .withColumn("kept", F.col("verdict") | ~F.col("any_kept"))
        .withColumn("rank", F.when(F.col("verdict") & F.col("any_kept"), F.col("__new")).otherwise(F.col("rank")))
        .drop("__new", "any_kept", "verdict", "reply")
    )


STRATEGIES = ("pointwise", "listwise")


def rerank(hits: DataFrame, queries: DataFrame, strategy: str, top_k: int = 4, provider: ChatProvider | None = None) -> DataFrame:
    if strategy == "pointwise":
        return pointwise(pointwise_replies(hits, queries, provider), top_k)
    if strategy == "listwise":
        hits = written(hits, "rerank_hits")  # read for the prompts and for the order
        return listwise(hits, listwise_replies(hits, queries, provider), top_k)
    raise ValueError(f"unknown reranking {strategy!r}; there are {', '.join(STRATEGIES)}")
