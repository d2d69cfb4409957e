"""Sources and sinks: document folders, query sets, index tables, embedding cache."""

from __future__ import annotations

import io
import json
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.cache import cache_key, cache_misses, embed_with_cache

__all__ = [
    "cache_key", "cache_misses", "embed_with_cache", "pdf_text", "read_documents", "read_eval_set", "read_index", "read_questions",
    "with_title", "write_index", "write_lines",
]

TEXT_SUFFIXES = ("txt", "md", "markdown")
DOCUMENTS = "doc_id string, title string, text string, origin string"


def pdf_text(content: bytes) -> str | None:
    """Page texts joined by blank lines; null without pypdf, on failure or without text."""
    try:
        from pypdf import PdfReader

        pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages]
    except ImportError:
        warnings.warn("pypdf is not installed: PDF files are skipped", stacklevel=2)
        return None
    except Exception:
        return None
    return "\n\n".join(p for p in pages if p) or None


def with_title(df: DataFrame) -> DataFrame:
    """Title: the first non-blank line if it is a level-one heading, else the file stem."""
    heading = F.regexp_extract("text", r"^\s*# ([^\r\n]*)", 1)
    return df.withColumn("title", F.coalesce(F.nullif(F.trim(heading), F.lit("")), F.col("doc_id")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents(doc_id, title, text, origin) of a folder, read recursively.

    Text and Markdown are decoded as UTF-8 with bad bytes replaced; PDF needs pypdf;
    other files are skipped, unreadable ones dropped. The folder may be on any file
    system that Spark reads.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.select(
        F.col("path").alias("origin"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"),
        F.url_decode(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("doc_id"), "content",
    )

    @F.pandas_udf("string")
    def pdf(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: pdf_text(bytes(c)))

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: bytes(c).decode("utf-8", errors="replace"))

    texts = named.filter(F.col("suffix").isin(*TEXT_SUFFIXES)).withColumn("text", decode("content"))
    pdfs = named.filter(F.col("suffix") == "pdf").withColumn("text", pdf("content")).filter("text is not null")
    found = with_title(texts.unionByName(pdfs)).select("doc_id", "title", "text", "origin")
    if not found.limit(1).count():
        raise ValueError(f"no readable document in {folder}")
    return found


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, text, reference), qrels(query_id, doc_id)) of a JSON array file."""
    schema = "pergunta string, docs_relevantes array<string>, resposta_referencia string"
    items = spark.read.schema(schema).json(path, multiLine=True)
    rows = items.select(F.md5("pergunta").alias("query_id"), "pergunta", "docs_relevantes", "resposta_referencia")
    queries = rows.select("query_id", F.col("pergunta").alias("text"), F.coalesce("resposta_referencia", F.lit("")).alias("reference"))
    return queries, rows.select("query_id", F.explode("docs_relevantes").alias("doc_id")).distinct()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a JSON array of strings."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(i, q) for i, q in enumerate(json.loads(text))], "query_id long, text string")


def write_index(index: DataFrame, path: str, model: str) -> None:
    """Chunks with their embeddings, and the embedder's name with every row."""
    index.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A written index; ValueError when it was made by another embedder than ``model``."""
    index = spark.read.parquet(path)
    if model is not None:
        other = index.filter(F.col("model") != model).select("model").limit(1).collect()
        if other:
            raise ValueError(f"the index was made with {other[0][0]!r}, not {model!r}: index again")
    return index.drop("model")


def write_lines(df: DataFrame, columns: list[str], echo: Callable[[str], None] = print) -> Iterator[str]:
    """A small result as lines of text, for the command line."""
    for row in df.select(*columns).toLocalIterator():
        line = "  ".join("" if v is None else str(v) for v in row)
        echo(line)
        yield line
