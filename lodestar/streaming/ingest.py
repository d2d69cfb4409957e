"""Incremental indexing: new files become chunks as they arrive.

An extension: a file stream of documents is chunked and appended to a chunk table;
texts that the table already holds are left out, so a repeated delivery changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.chunking import chunk_documents
from lodestar.sources.readers import cache_key

SCHEMA = "doc_id string, title string, text string"


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of documents(doc_id, title, text) from Parquet files that land in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def index_stream(docs: DataFrame, target: str, checkpoint: str, strategy: str = "recursive", size: int = 600, overlap: int = 100) -> StreamingQuery:
    """Appends the chunks of new texts to ``target``; runs until the input is used up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = chunk_documents(batch, strategy, size, overlap).withColumn("key", cache_key()).dropDuplicates(["key"])
        try:
            known = spark.read.parquet(target).filter(F.col("batch") != batch_id).select("key")
            fresh = fresh.join(known, "key", "left_anti")
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        # a batch that runs again replaces its own partition
        fresh.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch"
        ).parquet(target)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
