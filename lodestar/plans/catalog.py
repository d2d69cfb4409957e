"""Registered retrieval queries over the driver's tables, and their SQL oracles.

``documents`` is the corpus (``source`` stands for the title), ``benchmark`` the
queries, and a document is relevant to a query when it holds the query's passage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import replies as R
from lodestar.functions import text as T
from lodestar.operators import bounded, chunking, cluster, dense, embed, expansion, fusion, lexical, metrics, ordering, reflect, rerank, tree
from lodestar.plans import sql as S
from lodestar.plans.pipeline import BROADCAST_HITS, PRESETS, QUICK, STEPS, Config, Pipeline, ablation_by_query, compare_chunking, hash_embed, with_chunks
from lodestar.plans.pipeline import ablation as run_ablation
from lodestar.session import prepare, shared_dir, spread, written
from lodestar.sources import readers
from lodestar.sources.index_store import IndexStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: passages beyond this many are matched by shuffle
BROADCAST_PASSAGES = 20_000
SEED_WORDS = 6


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(prepare(spark), d)
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text"))


def chunked(docs: DataFrame) -> DataFrame:
    return chunking.chunk_documents(docs, "fixed").withColumn("ord", F.col("doc_id") * 100000 + F.col("position"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunked(corpus(spark, d))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    chunks = fixed_chunks(spark, d)
    asked = questions(spark, d)
    indexed = lexical.build_index(chunks.select("chunk_id", "ord", "title", "text"), queries=asked)
    return lexical.top_k(indexed, asked, k, chunks.select("chunk_id", "ord"))


def dense_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    chunks = fixed_chunks(spark, d)
    asked = questions(spark, d).select("query_id", embed.dense_column(F.col("text")).alias("embedding"))
    found = dense.top_k(chunks.select("chunk_id", "ord", "text"), asked, k, "chunk_id", "ord")
    return found.withColumnRenamed("id", "chunk_id")


def stacked_hits(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings as a table: searched once, whoever reads them how often."""
    return written(fusion.stack(dense_hits(spark, d), bm25_hits(spark, d)), "stacked")


def hybrid_hits(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return fusion.reciprocal_rank_fusion(stacked_hits(spark, d), top_k=k)


def placed_hits(spark: SparkSession, d: str, k: int = 7) -> DataFrame:
    """The best hybrid hits with their passages, as a table; only documents that were found are
    cut into passages again."""
    hits = written(hybrid_hits(spark, d, k), "hybrid")
    named = hits.select(F.substring_index("chunk_id", "#", 1).cast("long").alias("doc_id")).distinct()
    docs = corpus(spark, d).join(F.broadcast(named) if hits.count() <= BROADCAST_HITS else named, "doc_id", "left_semi")
    return written(with_chunks(hits, chunked(docs).select("chunk_id", "doc_id", "title", "position", "text")), "placed")


def passage_qrels(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents that hold a query's text verbatim.

    Joins on a run of inner words of the passage, then verifies; only passages too
    short for a run are held against every document.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    words = queries.select("query_id", F.col("text").alias("passage"), split(F.col("text")).alias("w"))
    runs = words.filter(F.size("w") >= SEED_WORDS + 2).select("query_id", "passage", F.xxhash64(F.slice("w", 2, SEED_WORDS)).alias("run"))
    if queries.count() <= BROADCAST_PASSAGES:
        runs = F.broadcast(runs)
    starts = F.when(F.size("w") >= SEED_WORDS, F.sequence(F.lit(1), F.size("w") - SEED_WORDS + 1)).otherwise(F.array().cast("array<int>"))
    held = docs.select("doc_id", "text", split(F.col("text")).alias("w")).select(
        "doc_id", "text", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, SEED_WORDS))))).alias("run")
    )
    found = held.join(runs, "run").filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = words.filter(F.size("w") < SEED_WORDS + 2).select("query_id", "passage")
    rest = docs.join(short, F.contains("text", "passage")).select("query_id", "doc_id")
    return found.unionByName(rest).distinct()


def qrels_of(spark: SparkSession, d: str) -> DataFrame:
    """As a table: the documents are searched once."""
    return written(passage_qrels(corpus(spark, d), questions(spark, d)), "qrels")


# --- chunking ---------------------------------------------------------------


@query("chunk_fixed", "WITH" + S.CHUNKS + " SELECT chunk_id, doc_id, position, text FROM chunks")
def chunk_fixed(spark, d):
    return fixed_chunks(spark, d).select("chunk_id", "doc_id", "position", "text")


@query(
    "chunk_sentences",
    "WITH" + S.SENTENCES + " SELECT doc_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::int AS position FROM sentences WHERE flat <> ''",
)
def chunk_sentences(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query("chunk_paragraphs", rf"""
SELECT doc_id, unnest(l) AS paragraph, (generate_subscripts(l, 1) - 1)::int AS position FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {S.stripped("p")}), lambda p: p <> '') AS l FROM documents)""")
def chunk_paragraphs(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"), "\n")).alias("position", "paragraph"))


@query("chunk_pack", S.PACKED + " SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS position FROM pieces")
def chunk_pack(spark, d):
    return chunking.chunk_documents(corpus(spark, d), "sentences").select("doc_id", "text", "position")


@query("chunk_recursive", S.PACKED + rf""",
whole AS (SELECT doc_id, {S.stripped("text")} AS t FROM documents)
SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS position FROM (
  SELECT doc_id, i, text FROM pieces JOIN whole USING (doc_id) WHERE length(t) > 600
  UNION ALL SELECT doc_id, 0, t FROM whole WHERE t <> '' AND length(t) <= 600)""")
def chunk_recursive(spark, d):
    return chunking.chunk_documents(corpus(spark, d), "recursive").select("doc_id", "text", "position")


@query("chunk_recursive_lines", S.LINE_CHUNKS + " SELECT chunk_id, doc_id, position, text FROM chunks")
def chunk_recursive_lines(spark, d):
    """Lines as paragraphs: packing, flushing and sentence fallback all occur."""
    lines = {"lines": lambda c, size, overlap: T.recursive_chunks(c, size, overlap, "\n")}
    return chunking.chunk_documents(corpus(spark, d), "lines", strategies=lines).select("chunk_id", "doc_id", "position", "text")


@query("chunk_stats", "WITH" + S.CHUNKS + """
SELECT title, count(*) AS n_chunks, round(avg(length(text)), 1) AS mean_chars, min(length(text))::int AS min_chars,
  max(length(text))::int AS max_chars, sum(length(text))::bigint AS total_chars FROM chunks GROUP BY title""")
def chunk_stats(spark, d):
    return chunking.chunk_stats(fixed_chunks(spark, d), "title")


@query("document_titles", r"""
SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '^\s*# ([^\r\n]*)', 1)), ''), doc_id::varchar) AS title
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# ' || text WHEN doc_id % 3 = 1 THEN chr(10) || '#  ' || chr(10) || text ELSE text END AS text FROM documents)""")
def document_titles(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.col("text"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("\n#  \n"), F.col("text"))
    ).otherwise(F.col("text"))
    docs = corpus(spark, d).select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    return readers.with_title(docs).select(F.col("n").alias("doc_id"), "title")


# --- lexical ----------------------------------------------------------------


def _index(spark, d):
    return lexical.build_index(fixed_chunks(spark, d))


@query("bm25_vocab", "WITH" + S.CHUNKS + "," + S.LEXICAL + " SELECT term, df, round(idf, 9) AS idf FROM terms")
def bm25_vocab(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_postings", "WITH" + S.CHUNKS + "," + S.LEXICAL + " SELECT term, chunk_id, tf FROM postings")
def bm25_postings(spark, d):
    return _index(spark, d).postings.select("term", "chunk_id", "tf")


@query("bm25_doclen", "WITH" + S.CHUNKS + "," + S.LEXICAL + " SELECT chunk_id, dl, round(1.5 * (0.25 + 0.75 * dl / avgdl), 9) AS norm FROM lengths, corpus")
def bm25_doclen(spark, d):
    return _index(spark, d).lengths.select("chunk_id", "dl", F.round("norm", 9).alias("norm"))


@query("bm25_topk", "WITH" + ",".join([S.CHUNKS, S.LEXICAL, S.QUERY_TERMS, S.BM25]) + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25_hits(spark, d, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


BM25_TOPK_SQL = ORACLES["bm25_topk"]
APPENDS = 3
LEAST_BUCKETS, BUCKET_CHARS = 8, 8_000_000


def store_buckets(docs: DataFrame) -> int:
    """Buckets that hold some BUCKET_CHARS of text each, so a task's share does not grow."""
    total = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_CHARS))


def _stored(spark, d, parts: int = 1, compacted: bool = False) -> IndexStore:
    """The chunks in a store, appended in so many parts, by document."""
    path = f"{shared_dir(spark)}/lodestar-index/store-{uuid.uuid4().hex}"
    store = IndexStore.create(spark, path, buckets=store_buckets(table(spark, d, "documents")))
    chunks = fixed_chunks(spark, d)
    for i in range(parts):
        store.append(chunks if parts == 1 else chunks.filter(F.pmod("doc_id", F.lit(parts)) == i))
    if compacted:
        store.compact()
        store.vacuum()
    return store


def _stored_hits(spark, d, parts: int, compacted: bool = False) -> DataFrame:
    store = _stored(spark, d, parts, compacted)
    found = bounded.top_k(store, questions(spark, d), 10, "ord")
    return found.hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_topk_bounded", BM25_TOPK_SQL)
def bm25_topk_bounded(spark, d):
    """From a stored index, without the postings that cannot matter."""
    return _stored_hits(spark, d, 1)


@query("bm25_topk_appended", BM25_TOPK_SQL)
def bm25_topk_appended(spark, d):
    """From a store that was appended to."""
    return _stored_hits(spark, d, APPENDS)


@query("bm25_topk_compacted", BM25_TOPK_SQL)
def bm25_topk_compacted(spark, d):
    """From a store whose segments were made one."""
    return _stored_hits(spark, d, APPENDS, True)


@query("bm25_rows_scored")
def bm25_rows_scored(spark, d):
    """Postings of each query: all, those read for the threshold, those scored after it."""
    return bounded.top_k(_stored(spark, d), questions(spark, d), 10).counts.select("query_id", "rows_all", "rows_first", "rows_essential", "rows_scored")


@query("index_terms", "WITH" + S.CHUNKS + "," + S.LEXICAL + " SELECT term, df, round(idf, 9) AS idf FROM terms")
def index_terms(spark, d):
    """Term statistics merged over the segments of a store."""
    return _stored(spark, d, APPENDS).lexical().terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_query_terms", "WITH" + ",".join([S.CHUNKS, S.LEXICAL, S.QUERY_TERMS]) + """
SELECT query_id, term, coalesce(df, 0) AS df, round(coalesce(idf, 0.0), 6) AS idf,
  (row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(idf, 0.0), 9) DESC, first_pos))::int AS place
FROM asked LEFT JOIN terms USING (term)""")
def bm25_query_terms(spark, d):
    found = lexical.explain_terms(_index(spark, d), questions(spark, d))
    return found.select("query_id", "term", "df", F.round("idf", 6).alias("idf"), "place")


@query("bm25_summary", "WITH" + S.CHUNKS + "," + S.LEXICAL + """
SELECT n_docs AS n_chunks, (SELECT count(*) FROM terms) AS vocabulary, round(avgdl, 6) AS avgdl, 1.5::double AS k1, 0.75::double AS b FROM corpus""")
def bm25_summary(spark, d):
    return lexical.index_summary(_index(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


# --- dense ------------------------------------------------------------------


@query("hash_embed_sparse", "WITH" + S.sparse("v", "documents", "doc_id") + " SELECT id AS doc_id, pos, round(w, 9) AS w FROM v")
def hash_embed_sparse(spark, d):
    v = embed.sparse_vectors(corpus(spark, d), "doc_id")
    return v.select(F.col("id").alias("doc_id"), "pos", (F.round("w", 9) + 0.0).alias("w"))


@query("hash_norms", "WITH" + S.sparse("v", "documents", "doc_id") + " SELECT d.doc_id, round(coalesce(n, 0.0), 9) AS norm FROM documents d LEFT JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY 1) ON id = doc_id")
def hash_norms(spark, d):
    v = hash_embed(corpus(spark, d).select(F.col("doc_id").alias("id"), "text"))
    return v.select(F.col("id").alias("doc_id"), F.round(dense.norm(F.col("embedding")), 9).alias("norm"))


VECTOR_PAIRS = """
q AS (SELECT vec_id AS query_id, embedding::double[] AS e, label FROM embeddings WHERE vec_id % 20 = 0),
scored AS (
  SELECT query_id, vec_id, q.label = v.label AS rel,
    round(list_inner_product(e, embedding::double[]) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(embedding::double[], embedding::double[]))), 9) AS score
  FROM q, embeddings v
),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM scored)"""


def _vector_hits(spark, d, k):
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(v, asked, k, "vec_id").withColumnRenamed("id", "vec_id")


@query("dense_topk_embeddings", "WITH" + VECTOR_PAIRS + " SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def dense_topk_embeddings(spark, d):
    return _vector_hits(spark, d, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("dense_topk_hash", "WITH" + ",".join([S.CHUNKS, S.DENSE]) + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 4")
def dense_topk_hash(spark, d):
    return dense_hits(spark, d, 4).select("query_id", "chunk_id", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("sparse_topk_hash", "WITH" + ",".join([S.CHUNKS, S.DENSE]).replace("ORDER BY score DESC, ord", "ORDER BY score DESC, chunk_id") + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 4")
def sparse_topk_hash(spark, d):
    v = embed.sparse_rows(fixed_chunks(spark, d), "chunk_id")
    q = embed.sparse_rows(questions(spark, d), "query_id").withColumnRenamed("id", "query_id")
    found = dense.sparse_top_k(v, q, 4)
    return found.select("query_id", F.col("id").alias("chunk_id"), (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("cosine_pairs", """
SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine,
  round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    v = table(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select(
        "vec_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"),
        F.round(dense.inner_product(F.col("embedding"), F.col("other")), 6).alias("dot"),
    )


@query("store_summary", "SELECT count(*) AS n_chunks, count(DISTINCT label) AS n_docs, max(len(embedding))::int AS dim, 'supplied' AS model FROM embeddings")
def store_summary(spark, d):
    return dense.index_summary(table(spark, d, "embeddings").withColumnRenamed("label", "doc_id"), "supplied")


@query("lookup_chunk", "WITH" + S.CHUNKS + " SELECT chunk_id, doc_id, position, text FROM chunks WHERE chunk_id = '7#000'")
def lookup_chunk(spark, d):
    return dense.lookup(fixed_chunks(spark, d), "7#000").select("chunk_id", "doc_id", "position", "text")


# --- fusion -----------------------------------------------------------------


@query("rrf_fusion", S.HITS + " SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM rrf WHERE rank <= 10")
def rrf_fusion(spark, d):
    return hybrid_hits(spark, d, 10).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("rrf_weighted", S.HITS.replace("sum(1.0::double / (60 + rank))", "sum(CASE ranker_id WHEN 0 THEN 0.7 ELSE 0.3 END::double / (60 + rank))") + " SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM rrf WHERE rank <= 10")
def rrf_weighted(spark, d):
    fused = fusion.reciprocal_rank_fusion(stacked_hits(spark, d), top_k=10, weights=[0.7, 0.3])
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


MIXED = S.HITS + """,
scaled AS (
  SELECT query_id, ranker_id, chunk_id, rank, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s
  FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM stacked WINDOW w AS (PARTITION BY query_id, ranker_id))
),
mixed AS (
  SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen))::int AS rank FROM (
    SELECT query_id, chunk_id, round(sum(s * CASE ranker_id WHEN 0 THEN 0.5 ELSE 0.5 END), 9) AS score, min({'a': ranker_id, 'b': rank}) AS seen
    FROM scaled GROUP BY ALL)
)"""


@query("min_max_scores", MIXED + " SELECT query_id, ranker_id, chunk_id, round(s, 6) AS score FROM scaled")
def min_max_scores(spark, d):
    return fusion.min_max(stacked_hits(spark, d)).select("query_id", "ranker_id", "chunk_id", F.round("score", 6).alias("score"))


@query("weighted_fusion", MIXED + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM mixed WHERE rank <= 10")
def weighted_fusion(spark, d):
    mixed = fusion.weighted_sum(dense_hits(spark, d), bm25_hits(spark, d), 0.5, 10)
    return mixed.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("dedup_hits", S.HITS + """
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY n))::int AS rank FROM (
  SELECT query_id, chunk_id, min(ranker_id * 1000 + rank) AS n FROM stacked GROUP BY ALL)""")
def dedup_hits(spark, d):
    one_list = stacked_hits(spark, d).withColumn("rank", F.col("ranker_id") * 1000 + F.col("rank"))
    return fusion.deduplicate(one_list).select("query_id", "chunk_id", "rank")


# --- ordering ---------------------------------------------------------------

ORDER_SQL = {
    "edges": "CASE WHEN n <= 2 THEN rank WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n - r // 2 + 1 END",
    "descending": "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)",
    "ascending": "row_number() OVER (PARTITION BY query_id ORDER BY score, rank)",
    "document": "row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, position, rank)",
}
for _name, _rule in ORDER_SQL.items():

    def _order(spark, d, strategy=_name):
        return ordering.reorder(placed_hits(spark, d), strategy).select("query_id", "chunk_id", F.col("rank").alias("place"))

    query(f"order_{_name}", S.PLACED + f"""
SELECT query_id, chunk_id, ({_rule})::int AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY query_id) AS n,
    max(score) OVER (PARTITION BY query_id, doc_id) AS best, min(rank) OVER (PARTITION BY query_id, doc_id) AS first FROM placed)""")(_order)


@query("truncate_context", S.PLACED + """
SELECT query_id, chunk_id, rank::int AS place FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY score DESC, rank ROWS UNBOUNDED PRECEDING) AS used FROM placed)
WHERE used <= 1500 OR rank = 1""")
def truncate_context(spark, d):
    return ordering.within_budget(placed_hits(spark, d), 1500).select("query_id", "chunk_id", F.col("rank").alias("place"))


@query("order_explain", S.PLACED + """
SELECT query_id, chunk_id, rank AS old_rank, (CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END)::int AS new_rank
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM placed)""")
def order_explain(spark, d):
    hits = placed_hits(spark, d)
    return ordering.explain(hits, ordering.edges(hits))


@query("context_prompt", S.PLACED + """
SELECT query_id, string_agg('[' || chunk_id || '] ' || coalesce(nullif(title, ''), doc_id::varchar) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  count(*)::int AS n_hits FROM placed WHERE rank <= 4 GROUP BY query_id""")
def context_prompt(spark, d):
    return reflect.contexts(placed_hits(spark, d, 4)).select("query_id", "context", "n_hits")


# --- evaluation -------------------------------------------------------------


@query("passage_qrels", "WITH" + S.QRELS + " SELECT query_id, doc_id FROM qrels")
def passage_qrels_query(spark, d):
    return qrels_of(spark, d)


@query("metrics_per_query", S.PLACED + "," + S.QRELS + ", hits AS (SELECT * FROM placed WHERE rank <= 4)," + S.metric_ctes("hits") + """
SELECT query_id, hit, round(rr, 6) AS rr, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg FROM per_query""")
def metrics_per_query(spark, d):
    out = metrics.per_query(questions(spark, d), placed_hits(spark, d, 4), qrels_of(spark, d))
    return out.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("rr", "recall", "precision", "ndcg")])


@query("metrics_summary", S.PLACED + "," + S.QRELS + ", hits AS (SELECT * FROM placed WHERE rank <= 4)," + S.metric_ctes("hits") + S.SUMMARY + ", 4 AS k FROM per_query")
def metrics_summary(spark, d):
    return metrics.evaluate(questions(spark, d), placed_hits(spark, d, 4), qrels_of(spark, d))


@query("metrics_vectors", "WITH" + VECTOR_PAIRS + """
SELECT query_id, round(count(*) FILTER (WHERE rel AND rank <= 4) / 4.0, 6) AS precision, coalesce(round(1.0 / min(rank) FILTER (WHERE rel), 6), 0.0) AS rr
FROM ranked WHERE rank <= 10 GROUP BY query_id""")
def metrics_vectors(spark, d):
    v = table(spark, d, "embeddings")
    hits = written(_vector_hits(spark, d, 10), "vector_hits").withColumn("doc_id", F.col("vec_id"))
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # only what was found is held against a query's label; the rest of a label is counted
    judged = hits.join(asked, "query_id").join(v.select("vec_id", F.col("label").alias("own")), "vec_id")
    rels = judged.filter("own = label").select("query_id", "doc_id")
    sizes = asked.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("n_rel")), "label").select("query_id", "n_rel")
    out = metrics.per_query(asked, hits, rels, sizes=sizes)
    return out.select("query_id", F.round("precision", 6).alias("precision"), F.round("rr", 6).alias("rr"))


def _config_sql(name: str, source: str) -> str:
    ctes = S.metric_ctes(f"hits_{name}")
    for cte in ("doc_ranks", "flagged", "found", "per_query"):
        ctes = ctes.replace(cte, f"{cte}_{name}")
    return f", hits_{name} AS (SELECT query_id, doc_id, h.rank AS rank FROM {source} h JOIN chunks USING (chunk_id) WHERE h.rank <= 4)," + ctes


@query("ablation", S.HITS + "," + S.QRELS + _config_sql("d", "dense") + _config_sql("b", "bm25") + _config_sql("h", "rrf") + "".join(
    f" {'UNION ALL ' if i else ''}SELECT '{n}' AS config, * FROM ({S.SUMMARY} FROM per_query_{k})" for i, (n, k) in enumerate((("dense", "d"), ("lexical", "b"), ("hybrid", "h")))))
def ablation_query(spark, d):
    asked, rels = questions(spark, d), qrels_of(spark, d)
    docs = fixed_chunks(spark, d).select("chunk_id", "doc_id")
    both = stacked_hits(spark, d)
    runs = {"dense": both.filter("ranker_id = 0"), "lexical": both.filter("ranker_id = 1"), "hybrid": fusion.reciprocal_rank_fusion(both, top_k=20)}
    tops = None
    for name, hits in runs.items():
        part = hits.filter("rank <= 4").select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")
        tops = part if tops is None else tops.unionByName(part)
    placed = written(with_chunks(tops, docs), "placed")  # one look at the chunks for all
    found = {n: placed.filter(F.col("config") == n) for n in runs}
    return metrics.comparison(metrics.by_config(asked, found, rels))


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("string"))


def _steps_sql(select: str, names=tuple(STEPS)) -> str:
    """The configurations one under the other."""
    return " UNION ALL ".join(f"SELECT '{n}' AS config, * FROM ({S.text_ids(S.measured(S.retrieval(STEPS[n]), 'shown'))} {select} FROM per_query)" for n in names)


@query("ablation_full", _steps_sql(S.SUMMARY))
def ablation_full(spark, d):
    """All five cumulative configurations over recursive chunks, with the local provider."""
    return run_ablation(_as_text(corpus(spark, d)), questions(spark, d), _as_text(qrels_of(spark, d)))


_REPORT_SQL = _steps_sql("SELECT query_id, hit, recall, precision, rr, ndcg", QUICK)


@query("ablation_report", f"""
WITH measured AS ({_REPORT_SQL})
SELECT config, CASE WHEN grouping(query_id) = 1 THEN 'config' ELSE 'query' END AS level, query_id, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall,
  round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries
FROM measured GROUP BY GROUPING SETS ((config, query_id), (config))""")
def ablation_report(spark, d):
    """Each query and each configuration without model calls, from one aggregation."""
    found = ablation_by_query(_as_text(corpus(spark, d)), questions(spark, d), _as_text(qrels_of(spark, d)), quick=True)
    return metrics.report(found)


@query("chunking_comparison", " UNION ALL ".join(
    f"SELECT '{n}' AS config, * FROM ({S.text_ids(S.measured(c + ',' + S.DENSE + ', found_chunks AS (SELECT query_id, doc_id, d.rank FROM dense d JOIN chunks USING (chunk_id))', 'found_chunks'))} {S.SUMMARY} FROM per_query)"
    for n, c in S.CHUNKED.items()))
def chunking_comparison(spark, d):
    return compare_chunking(_as_text(corpus(spark, d)), questions(spark, d), _as_text(qrels_of(spark, d)))


@query("hybrid_pipeline", S.HITS + """
SELECT query_id, chunk_id, doc_id, round(score, 9) AS score,
  (CASE WHEN n <= 2 THEN r.rank WHEN r.rank % 2 = 1 THEN (r.rank + 1) // 2 ELSE n - r.rank // 2 + 1 END)::int AS rank
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM rrf WHERE rank <= 4) r JOIN chunks USING (chunk_id)""")
def hybrid_pipeline(spark, d):
    """Chunks, both indexes, fusion and prompt order, end to end."""
    hits = ordering.reorder(placed_hits(spark, d, 4), "edges")
    return hits.select("query_id", "chunk_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def _pipeline_query(config: Config):
    def run(spark, d):
        pipeline = Pipeline(config=config)
        index = pipeline.index(corpus(spark, d))
        return pipeline.retrieve(index, questions(spark, d)).select("query_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    return run


for _name, _config in PRESETS.items():
    query(f"preset_{_name}", S.retrieval(_config) + """
SELECT query_id, chunk_id, doc_id::varchar AS doc_id, round(score, 6) AS score, rank FROM shown""")(_pipeline_query(_config))


PARTLY = "\n---\nRessalva da auto-avaliação: resposta parcialmente sustentada (utilidade 3/5)."  # as ``annotated`` puts it


@query("ask_full", S.asked(PRESETS["full"], R.NO_ANSWER, PARTLY))
def ask_full(spark, d):
    """Retrieval decision, answer, critique and annotation with the local provider."""
    pipeline = Pipeline(config=PRESETS["full"])
    return pipeline.ask(pipeline.index(corpus(spark, d)), questions(spark, d)).select(
        "query_id", "retrieve", "n_hits", F.array_join("chunk_ids", "|").alias("chunk_ids"), "answer", "abstained", F.col("critique.support").alias("support"), "final"
    )


# --- replies ----------------------------------------------------------------


def _picked(values: list[str | None], key: str = "doc_id"):
    """One of the replies for each row, by its id."""
    lits = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(lits, (F.col(key) % len(values)).cast("int"))


def _picked_sql(values: list[str | None], key: str = "doc_id") -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{key} % {len(values)} + 1]"


LINE_REPLIES = ["1. first one\n2) second 'one'\n\n - \"third\"", "* a\n\n  • b  ", "", "plain", '"quoted" line\n3.no space\n-', "10. ten\n  7) seven", None]
GRADE_REPLIES = ["8", "8/10", "7,5", "15", "10", "nota 9.25 de 10", "none", "0", "3.", None, "1000 e 4", "-2"]
ORDER_REPLIES = ["3,1,2", "2", "", "9 8 1", "[4] > [2] > [2]", "a1b2", None, "99999999999999999999 3"]
REL_REPLIES = [
    '{"relevante": true}', '{"relevante": false}', 'ok {"relevante": "false"} fim', "True, it is", "no", '{"x": 1}', '{"relevante": ', None,
    '{"relevante": 0}', '{"relevante": ""}', '{"relevante": null}', "{broken}",
]
RETRIEVE_REPLIES = ['{"recuperar": false, "motivo": "x"}', '{"recuperar": true}', '{"recuperar": "false"}', "nothing", None, '{"outro": 1}', '{"recuperar": 0}']
CRITIQUE_REPLIES = [
    '{"suporte": "fully", "utilidade": 5, "afirmacoes_sem_respaldo": [], "comentario": "ok"}',
    '{"suporte": "FULLY", "utilidade": 3}', '{"suporte": "maybe", "utilidade": 99, "afirmacoes_sem_respaldo": ["a","b","c","d","e","f"]}',
    '{"suporte": "no_support", "utilidade": -1, "afirmacoes_sem_respaldo": "text"}', "unreadable", None, "{}", '{"utilidade": "4", "suporte": "partially"}',
    '{"utilidade": "high", "comentario": "c"}',
]
ANSWERS = [R.NO_ANSWER, "Answer. " + R.NO_ANSWER.upper(), "A real answer [7#000].", "", R.NO_ANSWER[:20]]


@query("clean_lines", rf"""
SELECT doc_id, unnest(l) AS line, (generate_subscripts(l, 1) - 1)::int AS n FROM (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce({_picked_sql(LINE_REPLIES)}, ''), chr(10)),
    lambda x: trim(trim(trim(trim(regexp_replace(trim(x), '^\s*(\d+[.)]|[-*•])\s*', '')), '"'), ''''))), lambda x: x <> '') AS l FROM documents)""")
def clean_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _picked(LINE_REPLIES).alias("reply"))
    return docs.select("doc_id", F.posexplode(R.clean_lines(F.col("reply"))).alias("n", "line"))


@query("expand_dedup", """
WITH v AS (SELECT conv_id AS query_id, turn AS variant_no, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn + 1000, lower(text) || '  ' FROM conversations WHERE role = 'user')
SELECT query_id, text, (row_number() OVER (PARTITION BY query_id ORDER BY variant_no) - 1)::int AS variant_no FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY variant_no) AS n FROM v) WHERE n = 1""")
def expand_dedup(spark, d):
    said = table(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("variant_no"), "text")
    whispered = said.select("query_id", (F.col("variant_no") + 1000).alias("variant_no"), F.concat(F.lower("text"), F.lit("  ")).alias("text"))
    return expansion.ordered_variants(said.unionByName(whispered))


@query("hyde_mean_vector", """
SELECT label AS query_id, (pos - 1)::int AS pos, round(avg(x), 6) AS mean FROM (
  SELECT label, unnest(embedding::double[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""")
def hyde_mean_vector(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), "embedding")
    means = expansion.mean_vectors(v).select("query_id", F.posexplode("embedding").alias("pos", "mean"))
    return means.select("query_id", "pos", (F.round("mean", 6) + 0.0).alias("mean"))


@query("parse_grade", rf"""
SELECT doc_id, CASE WHEN w <> '' THEN least(10.0, greatest(0.0, (w || '.' || CASE WHEN p = '' THEN '0' ELSE p END)::double)) END AS grade FROM (
  SELECT doc_id, regexp_extract(r, '{R.GRADE}', 1) AS w, coalesce(regexp_extract(r, '{R.GRADE}', 2), '') AS p
  FROM (SELECT doc_id, {_picked_sql(GRADE_REPLIES)} AS r FROM documents))""")
def parse_grade(spark, d):
    return table(spark, d, "documents").select("doc_id", R.grade(_picked(GRADE_REPLIES)).alias("grade"))


GRADED = rf"""
graded AS (
  SELECT *, coalesce(CASE WHEN w <> '' THEN least(10.0, greatest(0.0, (w || '.' || CASE WHEN p = '' THEN '0' ELSE p END)::double)) END, 5.0) AS grade FROM (
    SELECT *, regexp_extract(r, '{R.GRADE}', 1) AS w, coalesce(regexp_extract(r, '{R.GRADE}', 2), '') AS p
    FROM (SELECT *, {_picked_sql(GRADE_REPLIES)} AS r FROM placed))
)"""


@query("rerank_pointwise", S.PLACED + "," + GRADED + """
SELECT query_id, chunk_id, grade, place FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, score DESC, rank))::int AS place FROM graded) WHERE place <= 4""")
def rerank_pointwise(spark, d):
    replied = placed_hits(spark, d).withColumn("reply", _picked(GRADE_REPLIES))
    return rerank.pointwise(replied).select("query_id", "chunk_id", "grade", F.col("rank").alias("place"))


@query("rerank_listwise", S.PLACED + rf""",
counts AS (SELECT query_id, count(*)::int AS n FROM placed GROUP BY 1),
named AS (
  SELECT query_id, n, list_filter(list_transform(regexp_extract_all(coalesce(CASE WHEN n > 1 THEN {_picked_sql(ORDER_REPLIES, "query_id")} END, ''), '\d+'),
    lambda x: TRY_CAST(x AS int)), lambda x: x IS NOT NULL AND x >= 1 AND x <= n) AS l FROM counts
),
first AS (SELECT query_id, n, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM named),
full_order AS (SELECT query_id, list_concat(l, list_filter(range(1, n + 1), lambda x: NOT list_contains(l, x::int))) AS l FROM first)
SELECT query_id, chunk_id, place::int AS place FROM (
  SELECT query_id, unnest(l) AS spot, generate_subscripts(l, 1) AS place FROM full_order) JOIN placed USING (query_id) WHERE spot = rank AND place <= 4""")
def rerank_listwise(spark, d):
    hits = placed_hits(spark, d)
    replied = questions(spark, d).select("query_id", _picked(ORDER_REPLIES, "query_id").alias("reply"))
    return rerank.listwise(hits, replied).select("query_id", "chunk_id", F.col("rank").alias("place"))


def _truthy_sql(obj: str, key: str) -> str:
    """A JSON value counts as true unless it is empty, zero, false or null."""
    return f"(json_extract({obj}, '$.{key}')::varchar NOT IN ('false', 'null', '0', '\"\"', '[]', '{{}}'))"


def _object_sql(r: str) -> str:
    return rf"(CASE WHEN json_valid(regexp_extract(coalesce({r}, ''), '(?s)\{{.*\}}')) THEN regexp_extract({r}, '(?s)\{{.*\}}') END)"


REL_SQL = rf"""CASE WHEN r IS NULL THEN true
  WHEN regexp_extract(r, '(?s)\{{.*\}}') <> '' THEN CASE WHEN {_object_sql("r")} IS NOT NULL AND json_exists({_object_sql("r")}, '$.relevante') THEN {_truthy_sql(_object_sql("r"), "relevante")} ELSE true END
  ELSE contains(lower(r), 'true') END"""


@query("isrel_filter", S.PLACED + f""",
judged AS (SELECT *, {REL_SQL} AS verdict FROM (SELECT *, {_picked_sql(REL_REPLIES)} AS r FROM placed)),
marked AS (SELECT *, max(verdict::int) OVER (PARTITION BY query_id) = 1 AS any_kept, row_number() OVER (PARTITION BY query_id, verdict ORDER BY rank) AS n FROM judged)
SELECT query_id, chunk_id, verdict OR NOT any_kept AS kept, (CASE WHEN verdict AND any_kept THEN n ELSE rank END)::int AS place FROM marked""")
def isrel_filter(spark, d):
    replied = placed_hits(spark, d).withColumn("reply", _picked(REL_REPLIES))
    return rerank.relevance_filter(replied).select("query_id", "chunk_id", "kept", F.col("rank").alias("place"))


@query("retrieve_decision", f"""
SELECT doc_id, CASE WHEN {_object_sql("r")} IS NOT NULL AND json_exists({_object_sql("r")}, '$.recuperar') THEN {_truthy_sql(_object_sql("r"), "recuperar")} ELSE true END AS retrieve
FROM (SELECT doc_id, {_picked_sql(RETRIEVE_REPLIES)} AS r FROM documents)""")
def retrieve_decision(spark, d):
    return table(spark, d, "documents").select("doc_id", R.should_retrieve(_picked(RETRIEVE_REPLIES)).alias("retrieve"))


CRITIQUE_SQL = f"""
WITH replied AS (SELECT doc_id, {_picked_sql(CRITIQUE_REPLIES)} AS r, (doc_id % 7 <> 0)::int AS n_hits FROM documents),
parsed AS (SELECT *, {_object_sql("r")} AS o FROM replied),
taken AS (
  SELECT doc_id, n_hits, r, o, o IS NOT NULL AND len(json_keys(o)) > 0 AS readable, lower(coalesce(json_extract_string(o, '$.suporte'), 'partially')) AS s,
    TRY_CAST(json_extract_string(o, '$.utilidade') AS int) AS u,
    CASE WHEN json_type(o, '$.afirmacoes_sem_respaldo') = 'ARRAY' THEN list_slice(json_extract_string(o, '$.afirmacoes_sem_respaldo[*]'), 1, 5) ELSE []::varchar[] END AS c
  FROM parsed
),
critiques AS (
  SELECT doc_id,
    CASE WHEN n_hits = 0 THEN 'no_support' WHEN r IS NULL OR NOT readable OR s NOT IN ('fully', 'partially', 'no_support') THEN 'partially' ELSE s END AS support,
    CASE WHEN n_hits = 0 THEN 1 WHEN r IS NULL OR NOT readable THEN 3 ELSE coalesce(greatest(1, least(5, u)), 3) END AS utility,
    CASE WHEN n_hits = 0 OR r IS NULL OR NOT readable THEN []::varchar[] ELSE c END AS claims
  FROM taken
)"""


def _critiques(spark, d):
    base = table(spark, d, "documents").select("doc_id", _picked(CRITIQUE_REPLIES).alias("reply"), (F.col("doc_id") % 7 != 0).cast("int").alias("n_hits"))
    return base.select("doc_id", R.critique(F.col("reply"), F.col("n_hits")).alias("c"))


@query("critique_sanitize", CRITIQUE_SQL + " SELECT doc_id, support, utility::int AS utility, array_to_string(claims, '|') AS claims, support = 'fully' AND utility >= 4 AS trusted FROM critiques")
def critique_sanitize(spark, d):
    c = F.col("c")
    return _critiques(spark, d).select(
        "doc_id", c["support"].alias("support"), c["utility"].alias("utility"), F.array_join(c["claims"], "|").alias("claims"), R.trusted(c).alias("trusted")
    )


@query("annotate_answer", CRITIQUE_SQL + """
SELECT doc_id, CASE WHEN support = 'fully' AND utility >= 4 THEN 'R' ELSE 'R' || chr(10) || '---' || chr(10) || 'Ressalva da auto-avaliação: resposta '
  || CASE support WHEN 'fully' THEN 'totalmente sustentada' WHEN 'partially' THEN 'parcialmente sustentada' ELSE 'sem respaldo no contexto' END
  || ' (utilidade ' || utility || '/5).'
  || CASE WHEN len(claims) > 0 THEN chr(10) || 'Afirmações sem respaldo direto no contexto recuperado:' || chr(10)
     || array_to_string(list_transform(claims, lambda x: '  - ' || x), chr(10)) ELSE '' END END AS final FROM critiques""")
def annotate_answer(spark, d):
    return _critiques(spark, d).select("doc_id", R.annotated(F.lit("R"), F.col("c")).alias("final"))


@query("abstention", f"SELECT doc_id, contains(lower(coalesce(a, '')), lower('{R.NO_ANSWER}')) AS abstained FROM (SELECT doc_id, {_picked_sql(ANSWERS)} AS a FROM documents)")
def abstention(spark, d):
    return table(spark, d, "documents").select("doc_id", R.abstains(_picked(ANSWERS)).alias("abstained"))


# --- cache, clustering, tree ------------------------------------------------


@query("cache_misses", """
SELECT key, max(length(text)) AS n_chars FROM (SELECT substr(sha256(text), 1, 32) AS key, text FROM documents) a
WHERE key NOT IN (SELECT substr(sha256(text), 1, 32) FROM documents WHERE lang <> 'en') GROUP BY key""")
def cache_misses(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.filter("lang <> 'en'").select(readers.cache_key().alias("key")).distinct()
    return readers.cache_misses(docs.select("text"), cache).select("key", F.length("text").cast("long").alias("n_chars"))


@query("kmeans_assign", """
WITH c AS (SELECT vec_id AS label, embedding::double[] AS e FROM embeddings WHERE vec_id < 10),
d AS (SELECT v.vec_id, c.label, round(1.0 - list_cosine_similarity(embedding::double[], e), 12) AS dist FROM embeddings v, c)
SELECT vec_id, label::int AS label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS n FROM d) WHERE n = 1""")
def kmeans_assign(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centres = v.filter("id < 10").select(F.col("id").cast("int").alias("label"), F.col("embedding").alias("centre"))
    return cluster.assign(v, centres).select(F.col("id").alias("vec_id"), "label")


LLOYD_ROUNDS, LLOYD_CENTRES = 3, 10


def _lloyd_sql() -> str:
    """Rounds from the first ten vectors, unrolled; an empty cluster keeps its centre."""
    ctes = [f"v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), c0 AS (SELECT vec_id AS label, e FROM v WHERE vec_id < {LLOYD_CENTRES})"]
    for i in range(LLOYD_ROUNDS):
        ctes.append(f"""d{i} AS (SELECT vec_id, v.e, label, round(1.0 - list_cosine_similarity(v.e, c.e), 12) AS dist FROM v, c{i} c),
a{i} AS (SELECT vec_id, e, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) AS n FROM d{i}) WHERE n = 1),
m{i} AS (SELECT label, list(x ORDER BY pos) AS e FROM (
  SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY label, pos) GROUP BY label),
c{i + 1} AS (SELECT c.label, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (label))""")
    return f"WITH {', '.join(ctes)} SELECT vec_id, label::int AS label FROM a{LLOYD_ROUNDS - 1}"


@query("kmeans_lloyd", _lloyd_sql())
def kmeans_lloyd(spark, d):
    """Lloyd rounds over all vectors from fixed centres."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    start = [r[0] for r in v.filter(F.col("id") < LLOYD_CENTRES).orderBy("id").select("embedding").collect()]
    return cluster.kmeans(v, LLOYD_CENTRES, LLOYD_ROUNDS, start=start).select(F.col("id").alias("vec_id"), "label")


@query("kmeans_cells")
def kmeans_cells(spark, d):
    """One cluster for every five vectors, made in cells: (label, n, least id) of each."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    labelled = cluster.kmeans(v, max(cluster.FAN + 1, v.count() // 5))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_vec_id"))


@query("kmeans_full")
def kmeans_full(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return cluster.kmeans(v, 10).select(F.col("id").alias("vec_id"), "label")


ASKED_SHARE = 20  # conversations whose number this divides are asked for


def conversation_leaves(spark, d) -> DataFrame:
    """One leaf a conversation: its turns in order."""
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return said.select(
        F.format_string("%s#000", F.col("conv_id").cast("string")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.lit("").alias("title"),
        F.lit(0).alias("position"), text.alias("text"),
    )


@query("summary_tree")
def summary_tree(spark, d):
    """Tree over all conversations, one leaf each, local summaries."""
    nodes = tree.build_tree(conversation_leaves(spark, d), hash_embed, cluster_size=25)
    return nodes.select("chunk_id", "doc_id", "level", F.size("children").alias("n_children"), F.length("text").alias("n_chars"))


def _tree_hits(spark, d, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(queries, hits) of the first turns of some conversations against the whole tree: a
    node and its summary count once."""
    nodes = written(tree.ancestry(tree.build_tree(conversation_leaves(spark, d), hash_embed, cluster_size=25)), "tree")
    asked = table(spark, d, "conversations").filter(F.col("conv_id") % ASKED_SHARE == 0).groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    found = dense.top_k(nodes.select("chunk_id", "text"), asked.select("query_id", embed.dense_column(F.col("text")).alias("embedding")), k, "chunk_id")
    found = found.withColumnRenamed("id", "chunk_id").drop("ord").join(nodes.select("chunk_id", "level", "doc_ids", "ancestors"), "chunk_id")
    return asked, tree.without_overlap(found)


@query("tree_topk")
def tree_topk(spark, d):
    """Hits over all levels of the conversations' tree."""
    return _tree_hits(spark, d)[1].select("query_id", "chunk_id", "level", F.round("score", 6).alias("score"), "rank", F.size("doc_ids").alias("n_docs"))


@query("metrics_tree")
def metrics_tree(spark, d):
    """Retrieval metrics over the tree, summaries credited to their documents."""
    asked, hits = _tree_hits(spark, d)
    rels = asked.select("query_id", F.col("query_id").cast("string").alias("doc_id"))
    return metrics.evaluate(asked, metrics.credited(hits), rels, 10)
