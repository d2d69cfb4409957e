"""Documents to chunks: the unit of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

STRATEGIES: dict[str, Callable[[Column, int, int], Column]] = {
    "fixed": T.window_chunks,
    "sentences": T.sentence_chunks,
    "recursive": T.recursive_chunks,
}


def chunk_documents(
    docs: DataFrame, strategy: str = "recursive", size: int = 600, overlap: int = 100, title: str | None = "title",
    keep: tuple[str, ...] = (), strategies: dict | None = None,
) -> DataFrame:
    """chunks(chunk_id, doc_id, title, position, text, strategy, *keep) of docs(doc_id, text).

    A narrow explode: no shuffle. ``strategies`` adds or replaces chunkers.
    """
    known = STRATEGIES | (strategies or {})
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(known)}")
    pieces = known[strategy](F.col("text"), size, overlap)
    name = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    out = docs.select("doc_id", name.alias("title"), *keep, F.posexplode_outer(pieces).alias("position", "chunk"))
    out = out.filter("chunk is not null")  # outer: a plain explode infers a filter that cuts the text a second time
    return out.select(
        F.format_string("%s#%03d", F.col("doc_id").cast("string"), F.col("position")).alias("chunk_id"), "doc_id", "title",
        "position", F.col("chunk").alias("text"), F.lit(strategy).alias("strategy"), *keep,
    )


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Number, mean (one decimal), least, most and total characters; zeros without chunks."""
    n = F.length("text")
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("mean_chars"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_chars"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_chars"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_chars"),
    )


def context_text() -> Column:
    """A chunk as the prompt shows it."""
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string"))
    return F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "), name, F.lit("\n"), F.col("text"))
