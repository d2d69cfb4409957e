"""Answers over the retrieved context, and their critique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import replies
from lodestar.operators.chunking import context_text
from lodestar.sources.providers import ChatProvider, LocalChat, ask

CONTEXT_CHARS = 8000


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context, n_hits, chunk_ids): passages in hit order, a blank line between."""
    rows = hits.select("query_id", F.struct("rank", context_text().alias("shown"), "chunk_id").alias("e"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("e")).alias("l"))
    return grouped.select(
        "query_id", F.array_join(F.transform("l", lambda e: e["shown"]), "\n\n").alias("context"), F.size("l").alias("n_hits"),
        F.transform("l", lambda e: e["chunk_id"]).alias("chunk_ids"),
    )


def retrieve_decisions(queries: DataFrame, provider: ChatProvider | None = None) -> DataFrame:
    reply = ask(provider or LocalChat(), "retrieve", F.col("text"), 0.0, 100)
    return queries.withColumn("reply", reply).withColumn("retrieve", replies.should_retrieve(F.col("reply"))).drop("reply")


def answers(queries: DataFrame, hits: DataFrame, provider: ChatProvider | None = None, temperature: float = 0.0, max_tokens: int = 600) -> DataFrame:
    """(query_id, question, context, n_hits, chunk_ids, answer, abstained).

    A query without hits gets the fixed abstention and no call.
    """
    joined = queries.select("query_id", F.col("text").alias("question")).join(contexts(hits), "query_id", "left")
    joined = joined.withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    prompt = F.when(F.col("n_hits") > 0, F.concat(F.col("question"), F.lit("\x1e"), F.col("context")))
    reply = ask(provider or LocalChat(), "answer", prompt, temperature, max_tokens)
    out = joined.withColumn("answer", F.when(F.col("n_hits") > 0, reply).otherwise(F.lit(replies.NO_ANSWER)))
    return out.withColumn("abstained", replies.abstains(F.col("answer")))


def closed_book_answers(queries: DataFrame, provider: ChatProvider | None = None, temperature: float = 0.0, max_tokens: int = 600) -> DataFrame:
    reply = ask(provider or LocalChat(), "answer", F.col("text"), temperature, max_tokens)
    return queries.select("query_id", F.col("text").alias("question"), reply.alias("answer"))


def critiques(answered: DataFrame, provider: ChatProvider | None = None) -> DataFrame:
    """answered with ``critique`` (null for abstentions) and ``final``, the annotated answer."""
    prompt = F.when(
        ~F.col("abstained") & (F.col("n_hits") > 0),
        F.concat(F.col("answer"), F.lit("\x1e"), F.substring("context", 1, CONTEXT_CHARS), F.lit("\n"), F.col("question")),
    )
    reply = ask(provider or LocalChat(), "critique", prompt, 0.0, 400)
    out = answered.withColumn("reply", reply)
    out = out.withColumn("critique", F.when(~F.col("abstained"), replies.critique(F.col("reply"), F.col("n_hits")))).drop("reply")
    return out.withColumn(
        "final", F.when(F.col("critique").isNull(), F.col("answer")).otherwise(replies.annotated(F.col("answer"), F.col("critique")))
    )
