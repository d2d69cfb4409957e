"""Dense retrieval: exact search over vectors."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.operators.best import Best, slice_rows
from lodestar.operators.embed import lowered, row_maker
from lodestar.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module
QUERY_BLOCK = 2048  # queries that one scan of the vectors answers; more are answered in further scans
SPARSE_PRODUCTS = 1 << 20  # products of sparse rows that are held at a time
DIGITS = 9  # scores are ranked after rounding, so every engine agrees on ties


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, inner_product(a, b) / size).otherwise(F.lit(0.0))


def _block_search(block, k: int, dim: int, schema: pa.Schema):
    """Best k vectors of a task for every query of the broadcast block (ids, matrix)."""
    made = row_maker(dim)

    def rows_of(column) -> np.ndarray:
        if pa.types.is_struct(column.type.value_type):
            sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            pos, w = (column.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = np.zeros((len(column), dim))
            rows[np.repeat(np.arange(len(column)), sizes), pos] = w
            return rows
        if (pc.list_value_length(column).to_numpy(zero_copy_only=False) != dim).any():
            raise ValueError(f"vectors and queries must have one dimension, which is {dim} for the queries")
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)

    def slices(column, step: int):
        """The vectors, so many at a time."""
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            for rows in made(column):  # a batch shares its hashes
                for lo in range(0, len(rows), step):
                    yield rows[lo : lo + step]
        else:
            for lo in range(0, len(column), step):
                yield rows_of(column.slice(lo, step))

    def search(batches):
        ids, matrix = block.value
        best, step = Best(len(ids), k), slice_rows(len(ids))
        for batch in batches:
            lo = 0
            for rows in slices(batch.column("vector"), step):
                size = np.sqrt((rows * rows).sum(axis=1))
                scores = np.round((rows @ matrix.T) / np.where(size > 0, size, 1.0)[:, None], DIGITS) + 0.0
                best.add(scores, batch.column("id").slice(lo, len(rows)), batch.column("ord").slice(lo, len(rows)))
                lo += len(rows)
        yield from best.batches(ids, schema)

    return search


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", ord_col: str | None = None, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """hits(query_id, id, ord, score, rank): exact cosine search, ties by ``ord_col``.

    ``vectors`` has (id, embedding), or (id, cells) for vectors of a few positions, which are
    filled up a slice at a time, or (id, text) for those of the hashing embedder, which are made
    in the task that searches them; ``queries`` has (query_id, embedding). k is at least 1. A task
    keeps its own best k a query, so what is shuffled is tasks * queries * k rows, never
    vectors * queries. Null vectors, of either side, are left out; vectors of another dimension
    than the queries are an error.
    """
    k = max(1, k)
    spark = vectors.sparkSession
    if "embedding" in vectors.columns:
        vector = F.col("embedding").cast("array<double>")
    else:
        vector = F.col("cells").cast(SPARSE) if "cells" in vectors.columns else lowered(F.col("text"))
    queries = queries.filter("embedding is not null")
    base = vectors.select(F.col(id_col).alias("id"), F.col(ord_col or id_col).alias("ord"), vector.alias("vector")).filter("vector is not null")
    kinds = dict(base.dtypes)
    query_kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_kind}, id {kinds['id']}, ord {kinds['ord']}, score double"
    first = queries.select(F.size("embedding").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], schema + ", rank int")
    types = to_arrow_schema(spark.createDataFrame([], schema).schema)
    n_blocks = -(-queries.count() // query_block)
    found = None
    for b in range(n_blocks):
        block = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        rows = block.select("query_id", F.col("embedding").cast("array<double>")).toArrow()
        if not rows.num_rows:
            continue
        matrix = np.stack([np.asarray(v, np.float64) for v in rows.column(1).to_pylist()])
        size = np.sqrt((matrix * matrix).sum(axis=1))
        matrix = matrix / np.where(size > 0, size, 1.0)[:, None]
        block_of = spark.sparkContext.broadcast((rows.column(0).to_pylist(), matrix))
        part = base.mapInArrow(_block_search(block_of, k, first["d"], types), schema)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ord").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def numbered(ids: DataFrame) -> DataFrame:
    """(id, at): the distinct ids numbered from 0 in their order."""
    sorted_ids = ids.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("m"))
    placed = written(sorted_ids.select("id", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "ids")
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect()):  # one row a partition
        starts.append((part, total))
        total += n
    offsets = F.broadcast(ids.sparkSession.createDataFrame(starts, "part long, start long"))
    return placed.join(offsets, "part").select("id", (F.col("row") + F.col("start")).alias("at"))


SPARSE = "array<struct<pos:int,w:double>>"


def packed_rows(cells: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, cells) of sparse rows that come as (id, pos, w), one row a cell."""
    pair = F.struct(F.col("pos").cast("int").alias("pos"), F.col("w").cast("double").alias("w"))
    return cells.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("cells"))


def inverted_scores(row: np.ndarray, at: np.ndarray, w: np.ndarray, n: int, n_queries: int, starts, numbers, weights) -> np.ndarray:
    """Scores, n rows by queries, of cells (row, place in the inverted list, weight)."""
    reps = starts[at + 1] - starts[at]
    first = np.repeat(np.cumsum(reps) - reps, reps)
    entry = np.repeat(starts[at], reps) + np.arange(int(reps.sum())) - first
    key = np.repeat(row, reps) * n_queries + numbers[entry]
    scores = np.bincount(key, np.repeat(w, reps) * weights[entry], n * n_queries).reshape(n, n_queries)
    return np.round(scores, DIGITS) + 0.0


def cell_slices(row: np.ndarray, products: np.ndarray, n: int, n_queries: int):
    """(lo, hi, cells) of runs of rows: so many rows, and products of their cells, at most."""
    total, step, lo = np.cumsum(products), slice_rows(n_queries), 0
    while lo < n:
        hi = min(n, lo + step, max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0.0) + SPARSE_PRODUCTS, "right"))))
        yield lo, hi, slice(*np.searchsorted(row, (lo, hi)))
        lo = hi


def _sparse_search(block, k: int, schema: pa.Schema):
    """Best k rows of a task for every query of the broadcast block (ids, positions, starts,
    query numbers, weights), an inverted list of the queries by position."""

    def search(batches):
        ids, positions, starts, numbers, weights = block.value
        best = Best(len(ids), k)
        for batch in batches:
            n, column = batch.num_rows, batch.column("cells")
            if not n:
                continue
            sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = column.flatten()
            row = np.repeat(np.arange(n), sizes)
            pos, w = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.minimum(np.searchsorted(positions, pos), max(0, len(positions) - 1))
            known = positions[at] == pos if len(positions) else np.zeros(len(pos), bool)
            row, at, w = row[known], at[known], w[known].astype(np.float64)
            products = np.bincount(row, starts[at + 1] - starts[at], n)
            for lo, hi, mine in cell_slices(row, products, n, len(ids)):
                scores = inverted_scores(row[mine] - lo, at[mine], w[mine], hi - lo, len(ids), starts, numbers, weights)
                part = batch.column("id").slice(lo, hi - lo)
                best.add(scores, part, part)
        for found in best.batches(ids, schema):
            yield found.drop_columns(["ord"])

    return search


def _inverted(asked: pa.Table) -> tuple:
    """The queries' cells as an inverted list by position."""
    ids = asked.column(0).to_pylist()
    cells = asked.column(1).combine_chunks()
    sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    pos, w = (cells.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    number = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(pos, kind="stable")
    positions, first = np.unique(pos[order], return_index=True)
    starts = np.append(first, len(pos))
    return ids, positions, starts, number[order], w[order].astype(np.float64)


def sparse_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, everything: DataFrame | None = None, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """hits(query_id, id, score, rank): exact search over sparse rows, ties by id.

    ``vectors`` has (id, cells), ``queries`` (query_id, cells), cells being an array of (pos, w)
    with one weight a position. Rows that share no position with a query, empty ones among
    them, score zero and rank behind those with positive scores; null cells are left out.
    Vectors are neither exploded nor shuffled: a task holds its rows against an inverted list of
    the queries, which is broadcast in blocks of bounded size, and keeps its best k a query, so
    what is shuffled is tasks * queries * k rows at most.

    Either side may come as (id, pos, w), one row a cell; it is packed first. ``everything``
    (id) then names the rows, those without cells among them.
    """
    k = max(1, k)
    spark = vectors.sparkSession
    if "pos" in vectors.columns:
        vectors = packed_rows(vectors)
    if everything is not None:
        vectors = everything.select("id").join(vectors, "id", "left").select("id", F.coalesce("cells", F.array().cast(SPARSE)).alias("cells"))
    if "pos" in queries.columns:
        queries = packed_rows(queries, "query_id").withColumnRenamed("id", "query_id")
    base = vectors.select("id", F.col("cells").cast(SPARSE).alias("cells")).filter("cells is not null")
    asked = queries.select("query_id", F.col("cells").cast(SPARSE).alias("cells")).filter("cells is not null")
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(base.dtypes)['id']}, score double"
    kind = dict(base.dtypes)["id"]
    types = to_arrow_schema(spark.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, id {kind}, ord {kind}, score double").schema)
    n_blocks = -(-asked.count() // query_block)
    found = None
    for b in range(n_blocks):
        block = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        rows = block.toArrow()
        if rows.num_rows:
            part = base.mapInArrow(_sparse_search(spark.sparkContext.broadcast(_inverted(rows)), k, types), schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def index_summary(index: DataFrame, model: str) -> DataFrame:
    """One row: chunks, distinct documents, dimension, model."""
    return index.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"),
    ).withColumn("model", F.lit(model))
