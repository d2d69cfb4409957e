"""Instructions, provider choice, one call a prompt, insertion order, null vectors, the command line."""

import json
import sys
import types

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import replies
from lodestar.operators import dense, embed, expansion, reflect, rerank
from lodestar.plans.pipeline import LOCAL_MODEL, PRESETS, Config, Pipeline, Settings, make_embedder, make_provider
from lodestar.sources import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])
TASKS = ("answer", "closed_book", "grade", "listwise", "relevant", "retrieve", "critique", "multi_query", "step_back", "decompose", "hypothesis", "summary")


@pytest.fixture
def fake_client(monkeypatch):
    """A stand-in for the client package that records what is sent."""
    sent = []

    def create(**call):
        sent.append(call)
        return types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content=" 7 "))])

    client = types.SimpleNamespace(chat=types.SimpleNamespace(completions=types.SimpleNamespace(create=create)))
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=lambda **_: client))
    monkeypatch.setenv("OPENAI_API_KEY", "x")
    return sent


@pytest.mark.parametrize("task", TASKS)
def test_every_task_has_an_instruction(fake_client, task):
    chat = providers.OpenAICompatibleChat("m")
    assert chat.reply(task, "the question\x1ea first passage\x1da second one", 0.2, 50) == "7"
    system, user = fake_client[0]["messages"]
    assert system["role"] == "system" and system["content"] == providers.INSTRUCTIONS[task]
    assert user["content"].count("the question") == 1 and "\x1e" not in user["content"]
    assert fake_client[0]["temperature"] == 0.2 and fake_client[0]["max_tokens"] == 50
    if task == "listwise":
        assert "[1] a first passage" in user["content"] and "[2] a second one" in user["content"]


def test_instructions_name_what_the_parsers_read():
    told = providers.INSTRUCTIONS
    assert replies.NO_ANSWER in told["answer"] and "relevante" in told["relevant"] and "recuperar" in told["retrieve"]
    assert all(k in told["critique"] for k in ("suporte", "utilidade", "afirmacoes_sem_respaldo", "comentario", "fully", "partially", "no_support"))
    assert set(told) == set(TASKS)


def test_a_worker_makes_one_client(monkeypatch, fake_client):
    made, whole = [], sys.modules["openai"].OpenAI
    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=lambda **a: made.append(a) or whole()))
    for model in ("m", "m", "n"):
        providers.OpenAICompatibleChat(model, "http://a").reply("grade", "q", 0.0, 5)
    providers.OpenAICompatibleChat("m", "http://b").reply("grade", "q", 0.0, 5)
    assert [a["base_url"] for a in made] == ["http://a", "http://b"] and len(fake_client) == 4
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(RuntimeError):
        providers.OpenAICompatibleChat("m", "http://a").reply("grade", "q", 0.0, 5)


class Counting:
    """Writes a line to a file for each call."""

    def __init__(self, path):
        self.path = path

    def reply(self, task, prompt, temperature, max_tokens):
        with open(self.path, "a") as f:
            f.write(json.dumps([task, prompt]) + "\n")
        return providers.LocalChat().reply(task, prompt, temperature, max_tokens)


def test_each_prompt_is_sent_once(spark, tmp_path):
    path = str(tmp_path / "calls")
    chat = Counting(path)
    docs = spark.createDataFrame([(i, f"t{i}", f"plain text {i} about the topic number {i} of the list") for i in range(12)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(0, "topic number 3"), (1, "plain list")], "query_id int, text string")
    pipeline = Pipeline(Settings(), Config(hyde=True, rewrite="multi_query", rerank="listwise", relevance_filter=True, retrieve_on_demand=True, critique=True), chat)
    out = pipeline.ask(pipeline.index(docs), asked).collect()
    assert len(out) == 2 and all(r["model"] == LOCAL_MODEL and r["techniques"] for r in out)
    calls = [tuple(json.loads(x)) for x in open(path)]
    assert {t for t, _ in calls} == {"retrieve", "multi_query", "hypothesis", "relevant", "listwise", "answer", "critique"}
    assert len(calls) == len(set(calls))


def test_embedder_and_provider_follow_the_settings(spark, tmp_path, monkeypatch):
    assert make_embedder(Settings())[1] == LOCAL_MODEL and isinstance(make_provider(Settings()), providers.LocalChat)
    for name, value in (("EMBEDDING_PROVIDER", "openrouter"), ("EMBEDDING_MODEL", "e"), ("MODEL", "c"), ("HYDE_TEMPERATURA", "0.4")):
        monkeypatch.setenv(name, value)
    settings = Settings.from_env()
    assert settings.hyde_temperature == 0.4 and make_embedder(settings)[1] == "e" and make_provider(settings).model == "c"
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    cached, _ = make_embedder(Settings(), str(tmp_path / "cache"))
    first = {r["id"]: r["embedding"] for r in cached(texts).collect()}
    assert first == {r["id"]: r["embedding"] for r in embed.packed_vectors(texts, "id").collect()}
    assert {r["id"]: r["embedding"] for r in cached(texts).collect()} == first
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_ties_go_by_insertion(spark):
    docs = spark.createDataFrame([(i, "", "same words here") for i in (2, 10, 1, -3)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(0, "same words")], "query_id int, text string")
    for preset in ("basic", "hybrid"):
        pipeline = Pipeline(Settings(), PRESETS[preset])
        hits = pipeline.retrieve(pipeline.index(docs, "fixed"), asked, 4).withColumn("at", F.col("rank")).collect()
        if preset == "basic":
            assert [r["doc_id"] for r in sorted(hits, key=lambda r: r["rank"])] == ["-3", "1", "2", "10"]


def test_dense_search_leaves_null_vectors_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, embedding array<double>")
    assert [(r["id"], r["rank"]) for r in dense.top_k(v, q, 5).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    bad = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="one dimension"):
        dense.top_k(bad, q, 5).collect()


def test_sparse_search_fills_up_by_id(spark):
    texts = spark.createDataFrame([(i, f"w{i % 3} common{i % 2}") for i in range(20)], "id long, text string")
    asked = spark.createDataFrame([(0, "w1 w2"), (1, "nothing"), (2, "common1")], "query_id long, text string")
    rows = embed.sparse_vectors(texts, "id")
    got = dense.sparse_top_k(rows, embed.sparse_vectors(asked, "query_id").withColumnRenamed("id", "query_id"), 15, texts.select("id")).collect()
    whole = dense.top_k(embed.packed_vectors(texts, "id"), embed.packed_vectors(asked, "query_id").withColumnRenamed("id", "query_id"), 15)
    want = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in whole.collect()}
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in got} == want


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "one.md").write_text("# One\n\nThe cat sat on the mat near the old door.")
    (folder / "two.txt").write_text("Two\n\nA dog ran over the long field of grass.")
    questions = tmp_path / "eval.json"
    questions.write_text(json.dumps([{"pergunta": "cat mat", "docs_relevantes": ["one"]}]))
    monkeypatch.setattr(cli, "session", lambda: spark)
    to = str(tmp_path / "index")
    assert cli.main(["ask", "--index", to, "cat"]) == 1
    assert cli.main(["index", str(folder), "--to", to, "--cache", str(tmp_path / "vectors")]) == 0
    assert cli.main(["ask", "--index", to, "cat on the mat"]) == 0
    assert cli.main(["bm25", "--index", to, "dog grass"]) == 0
    assert cli.main(["evaluate", "--index", to, str(questions)]) == 0
    assert cli.main(["compare", str(folder), str(questions), "--quick"]) == 0
    said = capsys.readouterr().out
    assert "techniques:" in said and "hybrid" in said and "vocabulary" in said
    assert "origin" in spark.read.parquet(f"{to}/chunks").columns
