"""Query expansion: rewrites, their deduplication, hypothetical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import replies
from lodestar.functions.text import strip
from lodestar.session import written
from lodestar.sources.providers import ChatProvider, LocalChat, ask

TECHNIQUES = {"multi_query": (3, 0.3, 300), "step_back": (1, 0.3, 120), "decompose": (4, 0.3, 300)}
HYDE_TEMPERATURE, HYDE_TOKENS = 0.7, 300
HYDE_STYLES = {
    "default": "Write a short passage that answers the question.",
    "scientific": "Write a paragraph of a scientific paper that answers the question.",
    "web": "Write a passage of a web page that answers the question.",
}


def ordered_variants(variants: DataFrame) -> DataFrame:
    """(query_id, variant_no, text) without repeats, compared trimmed and in lower case.

    Variant 0 is the query itself; of equal variants the first stays.
    """
    same = Window.partitionBy("query_id", F.lower(strip(F.col("text")))).orderBy("variant_no")
    kept = variants.withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")
    return kept.withColumn("variant_no", F.row_number().over(Window.partitionBy("query_id").orderBy("variant_no")) - 1)


def expand(queries: DataFrame, technique: str, n: int | None = None, provider: ChatProvider | None = None) -> DataFrame:
    """expanded(query_id, variant_no, text): the query and up to n rewrites of it.

    A failed call leaves the query alone.
    """
    if technique not in TECHNIQUES:
        raise ValueError(f"unknown technique {technique!r}; there are {', '.join(TECHNIQUES)}")
    most, temperature, tokens = TECHNIQUES[technique]
    reply = ask(provider or LocalChat(), technique, F.col("text"), temperature, tokens)
    lines = F.slice(replies.clean_lines(reply), 1, n or most)
    all_texts = F.concat(F.array("text"), lines)
    return ordered_variants(queries.select("query_id", F.posexplode(all_texts).alias("variant_no", "text")))


def hypothetical_documents(
    queries: DataFrame, n: int = 1, style: str = "default", provider: ChatProvider | None = None, temperature: float = HYDE_TEMPERATURE
) -> DataFrame:
    """(query_id, number, text): at least one call a query; empty replies are left out."""
    instruction = HYDE_STYLES.get(style, HYDE_STYLES["default"])
    numbered = queries.select("query_id", "text", F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))).alias("number"))
    prompt = F.concat(F.col("text"), F.lit("\x1e" + instruction + " "), F.col("number").cast("string"))
    reply = ask(provider or LocalChat(), "hypothesis", prompt, temperature, HYDE_TOKENS)
    # a call that fails discards all hypothetical documents of its query
    made = written(numbered.select("query_id", "number", reply.alias("text")), "hypotheses")  # each is asked for once
    failed = made.filter("text is null").select("query_id").distinct()
    return made.join(failed, "query_id", "left_anti").filter(strip(F.col("text")) != "")


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(query_id, embedding): element-wise mean of a query's vectors, not normalised again."""
    cells = vectors.select("query_id", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("embedding")
    )


def hyde_vectors(queries: DataFrame, hypothetical: DataFrame, embed, include_query: bool = True) -> DataFrame:
    """Mean of the embeddings of a query's hypothetical documents and of the query.

    ``embed`` maps (id, text) to (id, embedding). Queries without hypothetical
    documents always use their own text.
    """
    own = queries.select("query_id", F.lit(0).alias("number"), "text")
    if not include_query:
        own = own.join(hypothetical.select("query_id").distinct(), "query_id", "left_anti")
    texts = own.unionByName(hypothetical.select("query_id", "number", "text"))
    keyed = texts.select("query_id", F.concat_ws("/", F.col("query_id").cast("string"), F.col("number").cast("string")).alias("id"), "text")
    return mean_vectors(keyed.join(embed(keyed.select("id", "text")), "id").select("query_id", "embedding"))
