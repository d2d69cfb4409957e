"""Retrieval metrics per query and over a query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def document_ranks(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, query_id, doc_id, doc_pos): documents in order of their first hit."""
    first = hits.groupBy(*by, "query_id", "doc_id").agg(F.min("rank").alias("first"))
    order = Window.partitionBy(*by, "query_id").orderBy("first", "doc_id")
    return first.withColumn("doc_pos", F.row_number().over(order)).drop("first")


def credited(hits: DataFrame) -> DataFrame:
    """Hits on tree nodes as hits on their documents: a summary counts for each of ``doc_ids``."""
    return hits.withColumn("doc_id", F.explode("doc_ids"))


def per_query(
    queries: DataFrame, hits: DataFrame, qrels: DataFrame, k: int = 4, by: tuple[str, ...] = (), sizes: DataFrame | None = None
) -> DataFrame:
    """hit, rr, recall, precision and ndcg of every query; zeros where nothing was found.

    Hit and reciprocal rank use all retrieved documents, the rest the first k. The
    denominator of precision is the number of documents retrieved, at most k. With ``by``,
    columns of ``queries`` and of ``hits``, each of their values is a run of its own.
    ``sizes`` (query_id, n_rel) gives the numbers of relevant documents where ``qrels`` has only
    those that were found.
    """
    wanted = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    if sizes is None:
        sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    flagged = document_ranks(hits, by).join(wanted, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    top = F.col("doc_pos") <= k
    found = flagged.groupBy(*by, "query_id").agg(
        F.min(F.when(F.col("rel") == 1, F.col("doc_pos"))).alias("first_rel"),
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("hits_k"),
        F.sum(F.when(top, 1).otherwise(0)).alias("docs_k"),
        F.sum(F.when(top & (F.col("rel") == 1), F.lit(1.0) / F.log2(F.col("doc_pos") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    joined = queries.select(*by, "query_id").join(sizes, "query_id", "left").join(found, [*by, "query_id"], "left")
    best = F.least(F.coalesce("n_rel", F.lit(0)), F.lit(k)).cast("int")
    ideal = F.aggregate(
        F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
        lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)),
    )
    zero = F.lit(0.0)
    return joined.select(
        *by, "query_id",
        F.when(F.col("first_rel").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.col("first_rel"), zero).alias("rr"),
        F.when(F.col("n_rel") > 0, F.coalesce(F.col("hits_k") / F.col("n_rel"), zero)).otherwise(zero).alias("recall"),
        F.when(F.col("docs_k") > 0, F.col("hits_k") / F.col("docs_k")).otherwise(zero).alias("precision"),
        F.when(ideal > 0, F.coalesce(F.col("dcg"), zero) / ideal).otherwise(zero).alias("ndcg"),
    )


MEANS = (("hit", "hit"), ("recall", "recall"), ("precision", "precision"), ("rr", "mrr"), ("ndcg", "ndcg"))


def _means():
    return [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in MEANS]


def summary(metrics: DataFrame, k: int = 4) -> DataFrame:
    """One row of means over the queries."""
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *_means()).withColumn("k", F.lit(k))


def evaluate(queries: DataFrame, hits: DataFrame, qrels: DataFrame, k: int = 4) -> DataFrame:
    return summary(per_query(queries, hits, qrels, k), k)


def by_config(queries: DataFrame, runs: dict[str, DataFrame], qrels: DataFrame, k: int = 4) -> DataFrame:
    """(config, query_id, hit, rr, recall, precision, ndcg) of several runs, in one plan.

    ``runs`` maps a configuration's name to its hits (query_id, doc_id, rank). The name is a
    column of the hits, so documents are ranked, held against ``qrels`` and measured once for
    all runs; a query that a run found nothing for counts with zeros in it.
    """
    hits = None
    for name, df in runs.items():
        part = df.select(F.lit(name).alias("config"), "query_id", "doc_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    asked = queries.select("query_id", F.explode(F.array(*[F.lit(n) for n in runs])).alias("config"))
    return per_query(asked, hits, qrels, k, ("config",))


def comparison(measured: DataFrame) -> DataFrame:
    """(config, hit, recall, precision, mrr, ndcg, n_queries) of what ``by_config`` gives."""
    return measured.groupBy("config").agg(*_means(), F.count(F.lit(1)).alias("n_queries"))


def report(measured: DataFrame) -> DataFrame:
    """Both levels of what ``by_config`` gives from one aggregation: a row for each
    configuration and query, and one for each configuration, where query_id is null and
    ``level`` is 'config' (else 'query')."""
    sets = measured.groupingSets([["config", "query_id"], ["config"]], "config", "query_id")
    both = sets.agg(F.grouping("query_id").alias("all_queries"), *_means(), F.count(F.lit(1)).alias("n_queries"))
    level = F.when(F.col("all_queries") == 1, "config").otherwise("query")
    return both.select("config", level.alias("level"), "query_id", "hit", "recall", "precision", "mrr", "ndcg", "n_queries")
