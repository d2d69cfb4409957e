"""Reply parsers, reranking, reflection, tree, sources, pipelines."""

import json
import re
import sys
from dataclasses import dataclass, field

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.functions import replies as R
from lodestar.operators import cluster, expansion, metrics, reflect, rerank, tree
from lodestar.plans.pipeline import PRESETS, Config, Pipeline, Settings, Trace, ablation, hash_embed, runs_of
from lodestar.sources import providers, readers
from lodestar.streaming.ingest import document_stream, index_stream


cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Scripted:
    """Replies by task; an exception stands for a failed call."""

    replies: dict = field(default_factory=dict)

    def reply(self, task, prompt, temperature=0.0, max_tokens=100):
        r = self.replies[task]
        r = r(prompt) if callable(r) else r
        if isinstance(r, Exception):
            raise r
        return r


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "r string").select(expr(F.col("r"))).first()[0]


@pytest.mark.parametrize("reply,grade", [("8", 8.0), ("8/10", 8.0), ("7,5", 7.5), ("15", None), ("10", 10.0), ("x", None), (None, None), ("nota 0", 0.0)])
def test_grade(spark, reply, grade):
    assert one(spark, reply, R.grade) == grade


@pytest.mark.parametrize("reply,keep", [('{"relevante": true}', True), ('{"relevante": false}', False), ('{"relevante": "false"}', True),
                                        ("TRUE", True), ("no", False), (None, True), ("{bad}", True), ('{"relevante": 0}', False)])
def test_relevance(spark, reply, keep):
    assert one(spark, reply, R.is_relevant) is keep


@pytest.mark.parametrize("reply,retrieve", [('x {"recuperar": false} y', False), ("{}", True), (None, True), ('{"recuperar": ""}', False)])
def test_retrieve(spark, reply, retrieve):
    assert one(spark, reply, R.should_retrieve) is retrieve


def test_lines(spark):
    assert one(spark, '1. one\n\n- "two"\n3) \'three\'', R.clean_lines) == ["one", "two", "three"]


def test_listed_order(spark):
    expr = lambda c: R.listed_order(c, F.lit(3))
    assert one(spark, "3,1,2", expr) == [3, 1, 2]
    assert one(spark, "2", expr) == [2, 1, 3]
    assert one(spark, None, expr) == [1, 2, 3]
    assert one(spark, "9 2 2", expr) == [2, 1, 3]


def test_critique(spark):
    c = one(spark, '{"suporte": "nonsense", "utilidade": 99, "afirmacoes_sem_respaldo": ["a"]}', lambda x: R.critique(x, F.lit(2)))
    assert (c["support"], c["utility"], c["claims"]) == ("partially", 5, ["a"])
    assert one(spark, "{}", lambda x: R.critique(x, F.lit(0)))["support"] == "no_support"
    text = one(spark, '{"suporte": "fully", "utilidade": 4}', lambda x: R.annotated(F.lit("A"), R.critique(x, F.lit(1))))
    assert text == "A"


def hits(spark, n=3):
    return spark.createDataFrame([(0, f"c{i}", "d", "", 0, f"text {i}", 1.0 / i, i) for i in range(1, n + 1)],
                                 "query_id int, chunk_id string, doc_id string, title string, position int, text string, score double, rank int")


def ranked(df):
    return [r["chunk_id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]


def question(spark, text="what"):
    return spark.createDataFrame([(0, text)], "query_id int, text string")


def test_pointwise(spark):
    by_text = Scripted({"grade": lambda p: {"1": "3", "2": "9", "3": "7"}[p[-1]]})
    assert ranked(rerank.rerank(hits(spark), question(spark), "pointwise", 3, by_text)) == ["c2", "c3", "c1"]
    failing = Scripted({"grade": RuntimeError("x")})
    out = rerank.rerank(hits(spark), question(spark), "pointwise", 2, failing)
    assert ranked(out) == ["c1", "c2"] and out.first()["grade"] == 5.0


def test_listwise(spark):
    assert ranked(rerank.rerank(hits(spark), question(spark), "listwise", 3, Scripted({"listwise": "3,1,2"}))) == ["c3", "c1", "c2"]
    assert ranked(rerank.rerank(hits(spark), question(spark), "listwise", 3, Scripted({"listwise": RuntimeError()}))) == ["c1", "c2", "c3"]
    with pytest.raises(ValueError):
        rerank.rerank(hits(spark), question(spark), "other")


def test_relevance_filter(spark):
    verdicts = Scripted({"relevant": lambda p: '{"relevante": %s}' % ("false" if p[-1] == "2" else "true")})
    kept = rerank.relevance_filter(rerank.relevance_replies(hits(spark), question(spark), verdicts)).filter("kept")
    assert ranked(kept) == ["c1", "c3"] and {r["rank"] for r in kept.collect()} == {1, 2}
    none = Scripted({"relevant": '{"relevante": false}'})
    assert rerank.relevance_filter(rerank.relevance_replies(hits(spark), question(spark), none)).filter("kept").count() == 3


def test_expansion(spark):
    got = expansion.expand(question(spark, "Base"), "multi_query", 3, Scripted({"multi_query": "1. base\n2. other\n3. third\n4. x"}))
    assert [r["text"] for r in got.orderBy("variant_no").collect()] == ["Base", "other", "third"]
    failed = expansion.expand(question(spark, "Base"), "step_back", provider=Scripted({"step_back": RuntimeError()}))
    assert failed.count() == 1
    with pytest.raises(ValueError):
        expansion.expand(question(spark), "other")


def test_hyde(spark):
    q = question(spark, "um dois")
    plain = {r[0]: r[1] for r in hash_embed(q.select(F.col("query_id").alias("id"), "text")).collect()}[0]
    failed = expansion.hypothetical_documents(q, 2, provider=Scripted({"hypothesis": RuntimeError()}))
    assert np.allclose(expansion.hyde_vectors(q, failed, hash_embed).first()["embedding"], plain)
    same = expansion.hypothetical_documents(q, 2, provider=Scripted({"hypothesis": "um dois"}))
    assert same.count() == 2
    assert np.allclose(expansion.hyde_vectors(q, same, hash_embed).first()["embedding"], plain)


def test_answers(spark):
    row = reflect.answers(question(spark), hits(spark).limit(0), Scripted({"answer": RuntimeError("no call expected")})).first()
    assert row["abstained"] and row["n_hits"] == 0
    full = reflect.answers(question(spark), hits(spark), Scripted({"answer": "yes"}))
    assert full.first()["context"].startswith("[c1] d\ntext 1\n\n[c2]")
    judged = reflect.critiques(full, Scripted({"critique": '{"suporte": "no_support", "utilidade": 2}'})).first()
    assert judged["final"].startswith("yes\n---\n")


def test_kmeans(spark):
    rows = [[1, 0, 0], [0.9, 0.1, 0], [1, 0.05, 0], [0, 0, 1], [0, 0.1, 0.9], [0.05, 0, 1]]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id int, embedding array<double>")
    got = {r["id"]: r["label"] for r in cluster.kmeans(df, 2).collect()}
    assert len({got[0], got[1], got[2]}) == 1 and len({got[3], got[4], got[5]}) == 1 and got[0] != got[3]
    assert got == {r["id"]: r["label"] for r in cluster.kmeans(df, 2).collect()}
    assert cluster.kmeans(df, 99).count() == 6 and cluster.kmeans(df.limit(0), 3).count() == 0
    assert {r["label"] for r in cluster.kmeans(df, 1).collect()} == {0}


def corpus(spark, n=12):
    words = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    return spark.createDataFrame([(f"d{i:02d}", f"T{i}", f"{words[i % 3]} number{i} " * 3) for i in range(n)], "doc_id string, title string, text string")


def test_tree(spark):
    pipeline = Pipeline(Settings(cluster_size=3))
    index = pipeline.index(corpus(spark), "fixed", with_tree=True)
    nodes = index.chunks.collect()
    levels = {r["level"] for r in nodes}
    assert 0 in levels and 1 in levels
    assert sum(r["level"] == 0 for r in nodes) == 12
    assert all(r["chunk_id"].startswith("resumo_n") for r in nodes if r["level"] > 0)


def test_overlap_and_credit_of_tree_nodes(spark):
    """A node and its summary answer a query once; a summary is credited to its documents."""
    rows = [("a", 0, [], ["1"]), ("b", 0, [], ["2"]), ("c", 0, [], ["3"]), ("ab", 1, ["a", "b"], ["1", "2"]), ("abc", 2, ["ab", "c"], ["1", "2", "3"])]
    nodes = spark.createDataFrame(rows, "chunk_id string, level int, children array<string>, doc_ids array<string>")
    told = tree.ancestry(nodes)
    assert {r["chunk_id"]: r["ancestors"] for r in told.collect()} == {"a": ["ab", "abc"], "b": ["ab", "abc"], "c": ["abc"], "ab": ["abc"], "abc": []}
    found = [(1, "a", 1), (1, "ab", 2), (1, "b", 3), (1, "c", 4), (2, "abc", 1), (2, "c", 2), (3, "c", 1), (3, "ab", 2), (4, "b", 1), (4, "a", 2)]
    hits = spark.createDataFrame(found, "query_id int, chunk_id string, rank int").join(told, "chunk_id")
    left = tree.without_overlap(hits)

    def by_hand():
        above = {"a": {"ab", "abc"}, "b": {"ab", "abc"}, "c": {"abc"}, "ab": {"abc"}, "abc": set()}
        for q in range(1, 5):
            own = [(c, r) for x, c, r in found if x == q]
            kept = [c for c, r in own if not any(s < r and (d in above[c] or c in above[d]) for d, s in own)]
            yield from ((q, c, i + 1) for i, c in enumerate(kept))

    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in left.collect()) == sorted(by_hand())
    credits = metrics.credited(left).filter("query_id = 2").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["rank"]) for r in credits] == [("1", 1), ("2", 1), ("3", 1)]
    rels = spark.createDataFrame([(2, "3")], "query_id int, doc_id string")
    assert metrics.per_query(spark.createDataFrame([(2,)], "query_id int"), metrics.credited(left), rels).first()["hit"] == 1.0
    assert tree.without_overlap(hits.limit(0)).count() == 0 and tree.ancestry(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_presets(spark, preset):
    pipeline = Pipeline(config=PRESETS[preset])
    index = pipeline.index(corpus(spark), "recursive")
    got = pipeline.retrieve(index, question(spark, "alpha beta number3"), 3)
    assert got.count() == 3
    assert {r["rank"] for r in got.collect()} == {1, 2, 3}
    if preset in ("basic", "hybrid"):
        assert got.orderBy("rank").first()["doc_id"] == "d03"


def test_trace_counts_what_each_stage_passed_on(spark):
    """One answer, its stages counted by the run itself: no job beyond those of an untraced run."""
    provider = Scripted({
        "multi_query": "alpha beta\ndelta epsilon", "relevant": lambda p: json.dumps({"relevante": "number3" in p.split("\x1e")[1]}),
        "answer": "yes", "retrieve": '{"recuperar": true}', "critique": '{"suporte": "fully", "utilidade": 5}', "grade": "5",
    })
    config = Config(rewrite="multi_query", relevance_filter=True, retrieve_on_demand=True, critique=True)
    asked, jobs = question(spark, "alpha beta number3"), {}
    tracker = spark.sparkContext.statusTracker()
    for traced in (False, True):
        pipeline = Pipeline(config=config, provider=provider, trace=Trace() if traced else None)
        index = pipeline.index(corpus(spark), "recursive")
        spark.sparkContext.setJobGroup(f"traced-{traced}", "trace")
        rows = pipeline.ask(index, asked).collect()
        jobs[traced] = len(tracker.getJobIdsForGroup(f"traced-{traced}"))
    spark.sparkContext.setJobGroup("other", "other")
    told = {stage: (n, more) for stage, n, more in pipeline.trace.rows()}
    assert told["decisions"] == (1, {"retrieve": 1, "calls": 1})
    assert told["variants"] == (3, {"calls": 1})
    n, more = told["relevant"]
    assert told["candidates"][0] == n == more["calls"] == more["kept"] + more["dropped"] and more["kept"] == 1 and more["dropped"] >= 3
    assert told["hits"] == (rows[0]["n_hits"], {}) and rows[0]["n_hits"] == 1
    assert told["answers"] == (1, {"abstained": 0, "calls": 1}) and told["critiques"] == (1, {"calls": 1})
    row = pipeline.trace.row(spark).first()
    assert row["model_calls"] == 1 + 1 + n + 1 + 1 and row["seconds"] > 0 and len(row["stages"]) == 7
    assert jobs[True] <= jobs[False] + 8  # the hits are written once, nothing is counted by a job of its own


def test_weighted_and_ask(spark):
    pipeline = Pipeline(config=Config(fusion="weighted", critique=True, retrieve_on_demand=True))
    index = pipeline.index(corpus(spark), "fixed")
    row = pipeline.ask(index, question(spark, "alpha beta number3")).first()
    assert row["n_hits"] == 4 and row["final"] and row["retrieve"]
    no = Pipeline(config=Config(retrieve_on_demand=True), provider=Scripted({"retrieve": '{"recuperar": false}', "answer": "closed"}))
    assert no.ask(index, question(spark)).first()["answer"] == "closed"


def test_save_load_and_guard(spark, tmp_path):
    pipeline = Pipeline()
    pipeline.save(pipeline.index(corpus(spark), "fixed"), str(tmp_path / "x"))
    again = pipeline.load(spark, str(tmp_path / "x"))
    assert pipeline.retrieve(again, question(spark, "alpha"), 2).count() == 2
    with pytest.raises(ValueError):
        Pipeline(model="other").load(spark, str(tmp_path / "x"))


def test_ablation(spark):
    rel = spark.createDataFrame([(0, "d03")], "query_id int, doc_id string")
    rows = {r["config"]: r for r in ablation(corpus(spark), question(spark, "number3 alpha"), rel, quick=True).collect()}
    assert set(rows) == {"dense", "hybrid"} and rows["hybrid"]["hit"] == 1.0


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("\n# The title\n\nbody é")
    (tmp_path / "sub" / "b c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "skip.json").write_text("{}")
    rows = {r["doc_id"]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b c"}
    assert rows["a"]["title"] == "The title" and rows["b c"]["title"] == "b c" and "�" in rows["b c"]["text"]
    with pytest.raises(FileNotFoundError):
        readers.read_documents(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.bin").write_text("x")
    with pytest.raises(ValueError):
        readers.read_documents(spark, str(tmp_path / "empty"))


def test_eval_set(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"pergunta": "p", "docs_relevantes": ["a", "b"]}]')
    queries, qrels = readers.read_eval_set(spark, str(tmp_path / "q.json"))
    assert queries.first()["reference"] == "" and qrels.count() == 2
    (tmp_path / "u.json").write_text('["x", "y"]')
    assert readers.read_questions(spark, str(tmp_path / "u.json")).count() == 2


def test_embedding_cache(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c")], "id int, text string")
    calls = []

    def counted(df):
        calls.append(df.count())
        return hash_embed(df)

    got = {r["id"]: r["embedding"] for r in readers.embed_with_cache(texts, str(tmp_path / "c"), "m", counted).collect()}
    more = texts.union(spark.createDataFrame([(3, "d")], "id int, text string"))
    assert readers.embed_with_cache(more, str(tmp_path / "c"), "m", counted).count() == 4
    assert calls == [2, 1] and got[0] == got[1]


def test_embedding_batches():
    sent, waits = [], []

    class Flaky:
        name = "f"
        fails = 2

        def embed(self, texts):
            if self.fails:
                self.fails -= 1
                raise OSError
            sent.append(texts)
            return [[float(len(t))] for t in texts]

    assert providers.embed_batches(Flaky(), ["ab", " ", "c"], batch=2, wait=waits.append) == [[2.0], [1.0], [1.0]]
    assert waits == [1.0, 2.0] and sent == [["ab", " "], ["c"]]
    broken = Flaky()
    broken.fails = 99
    with pytest.raises(RuntimeError):
        providers.embed_batches(broken, ["a"], wait=waits.append)


def test_stream_appends_new_texts_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    corpus(spark, 3).write.mode("append").parquet(source)
    index_stream(document_stream(spark, source), target, mark, "fixed").awaitTermination()
    first = spark.read.parquet(target).count()
    corpus(spark, 4).write.mode("append").parquet(source)
    index_stream(document_stream(spark, source), target, mark, "fixed").awaitTermination()
    assert (first, spark.read.parquet(target).count()) == (3, 4)


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("TOP_K", "9")
    monkeypatch.setenv("PESO_DENSO", "0.25")
    s = Settings.from_env()
    assert s.top_k == 9 and s.dense_weight == 0.25 and s.chunk_size == 600


def test_configurations_are_measured_in_one_plan(spark):
    queries = spark.createDataFrame([(0, "a"), (1, "b")], "query_id int, text string")
    rel = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z")], "query_id int, doc_id string")
    hits = "query_id int, doc_id string, rank int"
    runs = {
        "one": spark.createDataFrame([(0, "x", 2), (0, "q", 1), (1, "z", 1)], hits),
        "two": spark.createDataFrame([(1, "q", 1), (1, "q", 2), (1, "z", 3)], hits),
        "none": spark.createDataFrame([], hits),
    }
    found = metrics.by_config(queries, runs, rel)
    for name, df in runs.items():
        alone = {r["query_id"]: r.asDict() for r in metrics.per_query(queries, df, rel).collect()}
        assert {r["query_id"]: r.asDict() for r in found.filter(found.config == name).drop("config").collect()} == alone
        mean = metrics.evaluate(queries, df, rel).drop("k").first().asDict()
        assert metrics.comparison(found).filter(f"config = '{name}'").drop("config").first().asDict() == mean
    both = metrics.report(found).collect()
    assert len(both) == 3 * 2 + 3 and {r["config"] for r in both if r["level"] == "config" and r["query_id"] is None} == set(runs)


def test_configurations_share_their_rankings(spark):
    """Each configuration finds what it finds alone; those that ask alike search once."""
    asked = question(spark, "number3 alpha")
    base = Pipeline()
    index = base.kept_index(corpus(spark))
    configs = {"dense": Config(hybrid=False), "hybrid": Config(), "rerank": Config(rerank="pointwise"), "hyde": Config(hyde=True)}
    runs = runs_of(index, asked, configs, base)
    for name, config in configs.items():
        assert sorted(runs[name].collect()) == sorted(Pipeline(config=config).retrieve(index, asked).collect())
    written_to = lambda df: set(re.findall(r"rankings-\w+", " ".join(df.inputFiles())))
    assert written_to(runs["dense"]) == written_to(runs["hybrid"]) == written_to(runs["rerank"]) != written_to(runs["hyde"])
