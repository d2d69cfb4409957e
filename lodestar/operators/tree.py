"""Summary tree: cosine k-means per level, a summary per cluster, all levels in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.cluster import kmeans
from lodestar.operators.dense import numbered
from lodestar.session import Scratch, written
from lodestar.sources.providers import ChatProvider, LocalChat, ask

MEMBER_CHARS, CLUSTER_CHARS, SUMMARY_WORDS = 1500, 12000, 200


def summaries(members: DataFrame, provider: ChatProvider | None = None, words: int = SUMMARY_WORDS) -> DataFrame:
    """(label, summary, n, children, doc_ids) of members(label, ord, chunk_id, doc_ids, text), two members at least."""
    grouped = members.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("ord", "chunk_id", F.substring("text", 1, MEMBER_CHARS).alias("t")))).alias("l"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"),
    ).filter("n > 1")
    text = F.substring(F.array_join(F.transform("l", lambda e: e["t"]), "\n\n---\n\n"), 1, CLUSTER_CHARS)
    reply = ask(provider or LocalChat(), "summary", F.concat(F.lit("\x1e"), text), 0.0, int(words * 2.5))
    return grouped.select("label", reply.alias("summary"), "n", F.transform("l", lambda e: e["chunk_id"]).alias("children"), "doc_ids")


def build_tree(chunks: DataFrame, embed, levels: int = 2, cluster_size: int = 5, provider: ChatProvider | None = None) -> DataFrame:
    """nodes(chunk_id, doc_id, title, position, text, level, children, doc_ids) of all levels.

    A level ends the tree when no more than cluster_size nodes are left. A cluster of
    one goes up as it is; one whose summary fails or is empty is left out above. Members
    come in the order of ``ord`` (by default of document and position), those of higher
    levels in the order of their clusters; it decides what a long cluster's summary sees.
    """
    spark = chunks.sparkSession
    scratch = Scratch(spark)
    doc = F.col("doc_id").cast("string")
    own = F.col("ord").cast("string") if "ord" in chunks.columns else F.concat(F.lpad(doc, 20, "0"), F.lit("\x01"), F.lpad(F.col("position").cast("string"), 10, "0"))
    layer = chunks.select(
        "chunk_id", doc.alias("doc_id"), "title", "position", "text", F.lit(0).alias("level"),
        F.array().cast("array<string>").alias("children"), F.array(doc).alias("doc_ids"), own.alias("ord"),
    )
    nodes = None
    for level in range(1, levels + 1):
        # each level is made once: its summaries may be a model's
        layer = written(layer, f"layer{level}")
        nodes = layer if nodes is None else nodes
        n = layer.count()
        if n <= cluster_size:
            break
        labelled = kmeans(embed(layer.select(F.col("chunk_id").alias("id"), "text")), max(2, n // cluster_size))
        members = layer.join(labelled.withColumnRenamed("id", "chunk_id"), "chunk_id")
        sizes = scratch.cut(members.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
        # the place of a label among the used ones names the summary and orders the level above
        places = numbered(sizes.select(F.col("label").alias("id"))).select(F.col("id").alias("label"), F.col("at").cast("int").alias("place"))
        above = F.lpad(F.col("place").cast("string"), 20, "0")
        single = members.drop("ord").join(sizes.filter("size = 1").select("label"), "label").join(places, "label").withColumn("ord", above).select(*layer.columns)
        made = summaries(members, provider).filter("summary is not null and trim(summary) <> ''").join(places, "label")
        new = made.select(
            F.format_string(f"resumo_n{level}_%02d", "place").alias("chunk_id"),
            F.array_join(F.slice("doc_ids", 1, 3), "+").alias("doc_id"),
            F.format_string(f"level {level} summary of %d passages", "n").alias("title"), F.col("place").alias("position"),
            F.col("summary").alias("text"), F.lit(level).alias("level"), "children", "doc_ids", above.alias("ord"),
        )
        new = written(new, f"summaries{level}")
        nodes = nodes.unionByName(new)
        layer = single.unionByName(new)
        if not layer.limit(1).count():
            break
    return (layer if nodes is None else nodes).drop("ord")


def ancestry(nodes: DataFrame) -> DataFrame:
    """nodes with ``ancestors``: the ids of all nodes above, nearest first. One join a level."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    edges = nodes.select(F.explode("children").alias("below"), F.col("chunk_id").alias("above"))
    reached, step = edges.withColumn("far", F.lit(1)), edges.withColumn("far", F.lit(1))
    for far in range(2, top + 1):
        up = edges.select(F.col("below").alias("above"), F.col("above").alias("higher"))
        step = step.join(up, "above").select("below", F.col("higher").alias("above"), F.lit(far).alias("far"))
        reached = reached.unionByName(step)
    lists = reached.groupBy(F.col("below").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "above"))), lambda x: x["above"]).alias("ancestors"))
    return nodes.join(lists, "chunk_id", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))


def without_overlap(hits: DataFrame) -> DataFrame:
    """hits(query_id, chunk_id, rank, ancestors, ...) without those of which a better hit of
    the query is a summary or a part; the rest are renumbered."""
    lower = hits.select("query_id", F.col("chunk_id").alias("low"), F.col("rank").alias("low_rank"), F.explode("ancestors").alias("high"))
    higher = hits.select("query_id", F.col("chunk_id").alias("high"), F.col("rank").alias("high_rank"))
    worse = F.when(F.col("low_rank") > F.col("high_rank"), F.col("low")).otherwise(F.col("high"))
    gone = lower.join(higher, ["query_id", "high"]).select("query_id", worse.alias("chunk_id")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.join(gone, ["query_id", "chunk_id"], "left_anti").withColumn("rank", place)
