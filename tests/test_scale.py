"""Searches keep the best of a task: results against brute force, and plans that do not grow."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import dense, embed, lexical, metrics
from lodestar.operators.best import Best
from lodestar.plans import catalog
from lodestar.plans import pipeline as P
from lodestar.session import _written, release

SCHEMA = pa.schema([("query_id", pa.int64()), ("id", pa.string()), ("ord", pa.int64()), ("score", pa.float64())])
WORDS = "vetor indice termo raro denso busca texto grafo".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_against_sorting():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (900, 4)) / 4.0  # many ties
    order = rng.permutation(900)
    best = Best(4, 5)
    best.room = 50
    for lo in range(0, 900, 70):
        part = slice(lo, lo + 70)
        best.add(scores[part], pa.array([f"c{i}" for i in range(900)][part]), pa.array(order[part]))
    rows = [r for b in best.batches([0, 1, 2, 3], SCHEMA) for r in b.to_pylist()]
    for q in range(4):
        want = np.lexsort((order, -scores[:, q]))[:5]
        assert [r["id"] for r in rows if r["query_id"] == q] == [f"c{i}" for i in want]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", "", " ".join(rng.choice(WORDS, rng.integers(1, 9))), 300 - i) for i in range(300)]
    return spark.createDataFrame(rows, "chunk_id string, title string, text string, ord int").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, f"{a} {b} {b}") for i, (a, b) in enumerate(zip(WORDS, WORDS[1:]))], "query_id int, text string")


def test_bm25_neither_joins_nor_shuffles_postings(chunks, asked, monkeypatch):
    index = lexical.build_index(chunks)
    found = lexical.top_k(index, asked, 4, chunks.select("chunk_id", "ord"))
    assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") <= 1
    texts = {r["chunk_id"]: (r["text"].split(), -r["ord"]) for r in chunks.collect()}
    mean = np.mean([len(w) for w, _ in texts.values()])
    df = {w: sum(w in t for t, _ in texts.values()) for w in WORDS}
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect())
    want = []
    for q, text in map(tuple, asked.collect()):
        score = lambda t: round(sum(np.log((300 - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split()), 9)
        best = sorted(((-score(t), -o, c) for c, (t, o) in texts.items() if score(t) > 0))[:4]
        want += [(q, i + 1, c) for i, (_, _, c) in enumerate(best)]
    assert got == sorted(want)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)  # more scans, the same hits; and an index without counts
    plain = lexical.LexicalIndex(index.postings, index.lengths, index.terms, index.corpus)
    for other in (index, plain):
        again = lexical.top_k(other, asked, 4, chunks.select("chunk_id", "ord"))
        assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in again.collect()) == got


def test_a_task_sends_k_hits_a_query(chunks, asked):
    one = chunks.coalesce(1).select("chunk_id", "ord", embed.sparse_column(F.col("text")).alias("cells"))
    vectors = asked.select("query_id", embed.dense_column(F.col("text")).alias("embedding"))
    found = dense.top_k(one, vectors, 2, "chunk_id", "ord")
    filled = chunks.select("chunk_id", "ord", embed.dense_column(F.col("text")).alias("embedding"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dense.top_k(filled, vectors, 2, "chunk_id", "ord").collect()))


def test_vectors_of_a_batch_are_those_of_its_rows(chunks, monkeypatch):
    texts = pa.array([r["text"].split() for r in chunks.collect()], pa.list_(pa.string()))
    whole = np.concatenate([w for w, _ in embed._filled(texts, 64, (1, 2))])
    monkeypatch.setattr(embed, "TOKENS", 7)
    monkeypatch.setattr(embed, "ROWS", 2)
    assert np.allclose(whole, np.concatenate([w for w, _ in embed._filled(texts, 64, (1, 2))]), atol=1e-12)


def test_a_batch_is_cut_into_tokens_bit_by_bit(chunks, monkeypatch):
    texts = pa.array([r["text"] for r in chunks.collect()] + ["", "vetor " * 50])
    whole = np.concatenate([w for w in embed.row_maker(64)(texts)])
    held, tokens = [], embed._tokens
    monkeypatch.setattr(embed, "_tokens", lambda part, pattern: held.append(len(part)) or tokens(part, pattern))
    monkeypatch.setattr(embed, "BYTES", 100)
    assert np.allclose(whole, np.concatenate([w for w in embed.row_maker(64)(texts)]), atol=1e-12)
    assert max(held) < len(texts) and sum(held) == len(texts)


def test_own_embeddings_need_no_join(spark, chunks):
    assert "Join" not in plan(P.Pipeline().embedded(chunks))


def test_sizes_stand_for_relevant_documents_not_listed(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, doc_id int, rank int")
    every = spark.createDataFrame([(q, d) for q in (1, 2) for d in (10, 12, 13)], "query_id int, doc_id int")
    sizes = spark.createDataFrame([(1, 3), (2, 3)], "query_id int, n_rel int")
    few = metrics.per_query(asked, hits, every.filter("doc_id = 10"), sizes=sizes)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, metrics.per_query(asked, hits, every).collect()))


def test_buckets_of_a_store_follow_its_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(100)] + [(100, None)], "doc_id long, text string")
    assert catalog.store_buckets(docs) == catalog.LEAST_BUCKETS
    monkeypatch.setattr(catalog, "BUCKET_CHARS", 5000)
    assert catalog.store_buckets(docs) == 20
    assert catalog.store_buckets(docs.limit(0)) == catalog.LEAST_BUCKETS


def test_vectors_of_texts_are_made_where_they_are_searched(spark, chunks, asked):
    vectors = asked.select("query_id", embed.dense_column(F.col("text")).alias("embedding"))
    texts = chunks.select("chunk_id", "ord", "text").unionByName(spark.createDataFrame([("none", 0, None)], "chunk_id string, ord int, text string"))
    found = dense.top_k(texts, vectors, 3, "chunk_id", "ord")
    filled = texts.select("chunk_id", "ord", embed.dense_column(F.col("text")).alias("embedding"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, dense.top_k(filled, vectors, 3, "chunk_id", "ord").collect()))


def test_accents_are_folded_in_the_worker(spark):
    rows = spark.createDataFrame([("a", "Ção", "ÀÉ ünico İx straße")], "chunk_id string, title string, text string")
    counted = lexical.chunk_counts(rows)
    assert "translate" not in plan(counted)
    want = rows.select(F.sort_array(T.lexical_tokens(F.concat_ws(" ", "title", "text")))).first()[0]
    assert sorted(t["term"] for t in counted.first()["tfs"]) == want


def test_only_documents_that_were_found_are_cut_again(spark):
    docs = spark.createDataFrame([("a#1", "t", "vetor raro " * 90), (None, "", "vetor denso"), ("c", "", "grafo")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([(1, "vetor raro denso")], "query_id int, text string")
    pipeline = P.Pipeline()
    found = pipeline.retrieve(pipeline.index(docs), queries)
    assert "LeftSemi" in plan(found)
    table = pipeline.retrieve(pipeline.kept_index(docs), queries)
    assert sorted(map(str, found.collect())) == sorted(map(str, table.collect())) and found.filter("chunk_id = 'null#000'").count() == 1


def test_chunkings_are_compared_without_tables_of_vectors(spark):
    docs = spark.createDataFrame([("a", "t", "vetor raro. " * 90), ("b", "", "grafo denso")], "doc_id string, title string, text string")
    queries = spark.createDataFrame([(1, "vetor raro")], "query_id int, text string")
    release(spark)
    P.compare_chunking(docs, queries, spark.createDataFrame([(1, "a")], "query_id int, doc_id string")).collect()
    assert not any("index_chunks" in name for held in _written.values() for name in held.paths)


def test_an_index_for_some_queries_holds_their_terms_only(spark, chunks, asked):
    few = asked.filter("query_id < 2")
    index, whole = lexical.build_index(chunks, queries=few), lexical.build_index(chunks)
    terms = {t["term"] for r in index.counts.collect() for t in r["tfs"]}
    assert terms == set(WORDS[:3])
    assert index.corpus.first() == whole.corpus.first()
    order = chunks.select("chunk_id", "ord")
    found = [sorted(map(tuple, lexical.top_k(i, few, 5, order).collect())) for i in (index, whole)]
    assert found[0] == found[1] and found[0]
