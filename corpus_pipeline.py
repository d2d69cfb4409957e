"""Corpus preparation in stages: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept. All but the last return the columns of their input; the last adds ``shard``
and ``slot``. For every stage: null ids and null texts are ordinary values (a null
text counts as empty), an empty table gives an empty table, long texts are read whole,
extra columns are carried through whatever their names, and rows that repeat an id are
rows of their own unless a stage says otherwise. A stage removes its intermediate
tables but for the small ones that its result reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import BITMAP_FILES, Scratch, bitmap, marked, prepare, table
from lodestar.llm.decontam import clean_documents
from lodestar.llm.mixing import MixTarget, mix_sources
from lodestar.llm.ngram_join import ngram_components
from lodestar.llm.quality import classify_quality
from lodestar.llm.sharding import shard_rows

SHARDS, SEED = 8, 7
MAX_REPETITION = 2.0


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weak-label quality classifier rejects.

    Equal texts fare alike; empty and null texts get no votes and are scored as such.
    """
    prepare(spark)
    whole = docs.select(F.struct(*_named(docs)).alias("row"), F.col("doc_id"), F.col("text"))
    return classify_quality(whole).filter("quality_keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Of near copies under one id the one with the least hash of its text stays, rows that
    repeat both id and text count as one, and texts that differ under one id fare apart.
    Documents without words are copies of nothing.
    """
    scratch = Scratch(spark)
    # a row is told by its id and the hash of its text
    key = F.xxhash64("text").alias("key")
    inner = Scratch(spark)
    found = ngram_components(docs.select(F.struct(F.col("doc_id"), key).alias("id"), "text"), inner, "id", "text")
    verdict = found.select(
        F.col("id.key").alias("key"), F.col("id.doc_id").alias("of"), (~F.col("id").eqNullSafe(F.col("component_id"))).alias("gone")
    )
    told = verdict.groupBy("key", "of").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("n"))
    told = scratch.cut(told.filter("gone or n > 1").select("key", "of", "gone"), "told")
    inner.close()
    rows = docs.select(F.struct(*_named(docs)).alias("row"), key, F.col("doc_id").alias("id"))
    # the bitmap lets most rows pass without a shuffle; those it holds are looked up
    split = marked(rows, scratch.cut(bitmap(told), "told_bits", BITMAP_FILES))
    held = (
        split.filter("hit").drop("hit").alias("d")
        .join(told.alias("t"), (F.col("d.key") == F.col("t.key")) & F.col("d.id").eqNullSafe(F.col("t.of")), "left")
        .filter("gone is null or not gone")
    )
    single = held.filter("gone is null").select("row.*")
    repeated = held.filter("gone is not null").select("row", "d.key", "id").dropDuplicates(["key", "id"]).select("row.*")
    return split.filter("not hit").select("row.*").unionByName(single).unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, verbatim or edited.

    Items of any id are looked for, null ids included; empty texts and items match nothing.
    """
    prepare(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the source shares by temperature; a document may come more than once.

    A null source is a source of its own; a null or empty text has no tokens and comes
    in whole passes only. The next stage makes the order, so only the copies matter here.
    """
    whole = docs.select(F.struct(*_named(docs)).alias("row"), F.col("doc_id"), F.col("source"), F.col("text"))
    return mix_sources(whole, Scratch(spark), MixTarget(max_repetition=MAX_REPETITION)).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle reproducibly into shards of sizes at most one apart.

    Rows equal in id and text are interchangeable. Columns named ``shard`` or ``slot``
    give way to those made here.
    """
    whole = docs.select(F.struct(*_named(docs)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = shard_rows(whole, [F.col("id"), F.col("hash")], SHARDS, SEED, Scratch(spark), "shard_rows")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: the classifier and the hashed permutations have no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    scratch = Scratch(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage_{name}")
        if last:
            scratch.drop(last)
        last = f"stage_{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
