"""Lexical, dense and fused retrieval on hand-checked tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import cluster, dense, embed, expansion, fusion, lexical, metrics, ordering, tree

CHUNKS = [
    ("a#000", "a", "", "a função de ranqueamento usa termos raros", 0),
    ("b#000", "b", "ranqueamento", "outro texto sobre vetores densos", 0),
    ("c#000", "c", "", "de a o e", 0),
    ("d#000", "d", "", "vetores vetores vetores densos e termos", 0),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, title string, text string, position int").cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_tokens(spark):
    df = spark.createDataFrame([("A função de ranqueamento NÃO",)], "t string")
    assert df.select(T.lexical_tokens(F.col("t"))).first()[0] == ["funcao", "ranqueamento", "nao"]
    assert df.select(T.lexical_tokens(F.col("t"), exact=True)).first()[0] == ["funcao", "ranqueamento", "nao"]
    assert df.select(T.hash_tokens(F.col("t"))).first()[0] == ["a", "função", "de", "ranqueamento", "não"]


def bm25(query):
    docs = {c[0]: [w for w in (c[2] + " " + c[3]).replace("ç", "c").replace("ã", "a").split() if len(w) > 1 and w not in T.STOP_WORDS] for c in CHUNKS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for k, words in docs.items():
        s = 0.0
        for q in query:
            df = sum(q in w for w in docs.values())
            tf = words.count(q)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if s > 0:
            out[k] = s
    return out


def test_bm25_matches_the_formula(spark, chunks):
    index = lexical.build_index(chunks)
    got = lexical.top_k(index, queries(spark, "vetores densos vetores", "ranqueamento", "de a o", "zzz"), 10).collect()
    by = {q: {r["chunk_id"]: r["score"] for r in got if r["query_id"] == q} for q in range(4)}
    assert by[0] == pytest.approx(bm25(["vetores", "densos", "vetores"]), abs=1e-8)
    assert by[1] == pytest.approx(bm25(["ranqueamento"]), abs=1e-8)
    assert by[2] == {} and by[3] == {}
    assert lexical.index_summary(index).first()["n_chunks"] == 4


def test_query_terms_keep_unknown_words(spark, chunks):
    rows = lexical.explain_terms(lexical.build_index(chunks), queries(spark, "termos zzz termos vetores")).orderBy("place").collect()
    assert [r["term"] for r in rows] == ["termos", "vetores", "zzz"]
    assert rows[-1]["idf"] == 0.0


def test_index_round_trip(spark, chunks, tmp_path):
    index = lexical.build_index(chunks)
    index.write(str(tmp_path / "i"))
    again = lexical.LexicalIndex.read(spark, str(tmp_path / "i"))
    q = queries(spark, "vetores termos")
    assert sorted(map(tuple, lexical.top_k(again, q).collect())) == sorted(map(tuple, lexical.top_k(index, q).collect()))


def hash_vector(text, dim=512):
    words = text.lower().split()
    terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    v = np.zeros(dim)
    for t in set(terms):
        h = hashlib.md5(t.encode()).digest()
        v[int.from_bytes(h[:4], "big") % dim] += (1 if h[4] % 2 == 0 else -1) * (1 + math.log(terms.count(t)))
    return v / (np.linalg.norm(v) or 1)


def test_hash_vectors(spark):
    texts = ["um dois dois três", "só", "", "a b a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed.packed_vectors(df, "id").collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], hash_vector(t))
    rows = embed.sparse_vectors(df, "id").collect()
    for r in rows:
        assert r["w"] == pytest.approx(got[r["id"]][r["pos"]])
    assert {r["id"] for r in rows} == {0, 1, 3}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(dense.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("block", [2048, 3])
def test_exact_search(spark, block):
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(60, 8)).round(1)
    rows[7] = rows[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>").repartition(5)
    q = df.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = dense.top_k(df, q, 5, query_block=block).collect()
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    for i in range(0, 60, 7):
        s = np.round(unit @ unit[i], 9)
        want = sorted(range(60), key=lambda j: (-s[j], j))[:5]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want
    assert dense.top_k(df, q.limit(0), 5).count() == 0
    assert dense.top_k(df, q, 0).count() == q.count()


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def ranked(df):
    return [r["chunk_id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_rrf(spark):
    one, two = hits(spark, [(0, "a", 3.0, 1), (0, "b", 2.0, 2), (0, "c", 1.0, 3)]), hits(spark, [(0, "c", 3.0, 1), (0, "d", 2.0, 2), (0, "a", 1.0, 3)])
    fused = fusion.reciprocal_rank_fusion(fusion.stack(one, two))
    assert ranked(fused) == ["a", "c", "b", "d"]
    assert fused.filter("chunk_id = 'a'").first()["score"] == pytest.approx(1 / 61 + 1 / 63)
    heavy = fusion.reciprocal_rank_fusion(fusion.stack(one, two), weights=[0.1, 1.0])
    assert ranked(heavy)[0] == "c"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(fusion.stack(one, two), weights=[1.0])


def test_weighted_sum(spark):
    one, two = hits(spark, [(0, "a", 3.0, 1), (0, "b", 2.0, 2)]), hits(spark, [(0, "c", 5.0, 1), (0, "a", 5.0, 2)])
    rows = {r["chunk_id"]: r["score"] for r in fusion.weighted_sum(one, two, 0.5).collect()}
    assert rows == {"a": 1.0, "c": 0.5, "b": 0.0}
    with pytest.raises(ValueError):
        fusion.weighted_sum(one, two, 1.5)


def test_deduplicate(spark):
    df = hits(spark, [(0, "a", 1.0, 1), (0, "b", 1.0, 2), (0, "a", 9.0, 3), (0, "c", 1.0, 4)])
    assert ranked(fusion.deduplicate(df)) == ["a", "b", "c"]


def placed(spark, n=7):
    return spark.createDataFrame([(0, f"c{i}", f"d{i % 2}", n - i, 1.0 / i, i, "x" * 500) for i in range(1, n + 1)],
                                 "query_id int, chunk_id string, doc_id string, position int, score double, rank int, text string")


def test_orders(spark):
    df = placed(spark)
    assert ranked(ordering.edges(df)) == ["c1", "c3", "c5", "c7", "c6", "c4", "c2"]
    assert ranked(ordering.ascending(df)) == [f"c{i}" for i in range(7, 0, -1)]
    assert ranked(ordering.descending(df)) == [f"c{i}" for i in range(1, 8)]
    assert ranked(ordering.by_document(df)) == ["c7", "c5", "c3", "c1", "c6", "c4", "c2"]
    assert ranked(ordering.edges(placed(spark, 2))) == ["c1", "c2"]
    assert ordering.within_budget(df, 1200).count() == 2
    assert ordering.within_budget(df, 10).count() == 1
    with pytest.raises(ValueError):
        ordering.reorder(df, "other")


def test_metrics(spark):
    h = spark.createDataFrame([(0, "x", 1), (0, "a", 2), (0, "a", 3), (0, "b", 4), (0, "y", 5), (1, "a", 1)], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "q")], "query_id int, doc_id string")
    q = queries(spark, "p", "q", "r", "s")
    rows = {r["query_id"]: r for r in metrics.per_query(q, h, rel, 4).collect()}
    assert (rows[0]["hit"], rows[0]["rr"], rows[0]["recall"], rows[0]["precision"]) == (1.0, 0.5, 1.0, 0.5)
    assert rows[1]["ndcg"] == 1.0 and rows[1]["precision"] == 1.0
    assert rows[2]["hit"] == 0.0 and rows[3]["recall"] == 0.0
    assert rows[0]["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert metrics.evaluate(q, h, rel).first()["n_queries"] == 4


def test_mean_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [0.0, 1.0])], "query_id int, embedding array<double>")
    assert {r[0]: r[1] for r in expansion.mean_vectors(df).collect()} == {0: [2.0, 4.0], 1: [0.0, 1.0]}


def test_kmeans_seeds_from_all_rows(spark):
    groups = {i: [1.0, 0.0, 0.0] for i in range(300)} | {300: [0.0, 1.0, 0.0], 301: [0.0, 1.0, 0.0], 302: [0.0, 0.0, 1.0]}
    got = dict(cluster.kmeans(spark.createDataFrame(list(groups.items()), "id long, embedding array<double>"), 3).collect())
    assert len(set(got.values())) == 3 and got[300] == got[301] != got[302] != got[0] != got[300]
    apart = {i: [math.cos(i * math.pi / 62), math.sin(i * math.pi / 62)] for i in range(31)}
    got = dict(cluster.kmeans(spark.createDataFrame(list(apart.items()), "id long, embedding array<double>"), 25).collect())
    assert len(set(got.values())) == 25


def test_sparse_search_keeps_the_best_of_each_task(spark):
    """Packed rows against every pair by hand, over several tasks, batches and blocks of queries."""
    rng = np.random.default_rng(5)

    def rows(n, dim=40):
        out = []
        for i in range(n):
            pos = np.sort(rng.choice(dim, int(rng.integers(0, 6)), replace=False))
            out.append((f"r{i:04d}", [(int(p), float(w)) for p, w in zip(pos, rng.integers(-3, 4, len(pos)))]))
        return out

    vectors, asked = rows(500), rows(7, 60)
    schema = "id string, cells array<struct<pos:int,w:double>>"
    v = spark.createDataFrame(vectors + [("null", None)], schema).repartition(5)
    q = spark.createDataFrame(asked, schema).withColumnRenamed("id", "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        for block in (3, 2048):
            got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in dense.sparse_top_k(v, q, 6, query_block=block).collect()}
            want = {}
            for name, cells in asked:
                of = dict(cells)
                scored = sorted((-sum(w * of.get(p, 0.0) for p, w in c), i) for i, c in vectors)[:6]
                want |= {(name, n + 1): (i, -s + 0.0) for n, (s, i) in enumerate(scored)}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = dense.sparse_top_k(v, q, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan  # nothing a cell or a pair
    assert dense.sparse_top_k(v, q.limit(0), 6).count() == 0
