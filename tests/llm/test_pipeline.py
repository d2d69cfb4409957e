"""The staged pipeline on a small corpus, against a plain re-statement."""

import collections
import random

import corpus_pipeline as P
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(21)
    word = lambda i: draw.choice(["the", "of", "and", "is"]) if i % 3 == 1 else f"word{draw.randrange(3000)}"
    prose = lambda n: " ".join(word(i) + ("." if i % 9 == 8 else "") for i in range(n))
    texts = [prose(draw.randrange(60, 160)) for _ in range(120)]
    junk = list(range(120, 135))
    texts += [" ".join(x.upper() + "!!" for x in prose(50).split()) for _ in junk]
    copies = list(range(135, 150))
    texts += [texts[i] + (" tail" if i % 2 else "") for i in range(15)]
    item = prose(40)
    leaks = list(range(150, 155))
    texts += [prose(60) + " " + item + " " + prose(30) for _ in leaks]
    source = ["big" if i % 3 else f"s{i % 5}" for i in range(len(texts))]
    return [(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, source))], item, junk, copies, leaks


def test_stages(spark, tmp_path):
    rows, item, junk, copies, leaks = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = P.run(spark, d).collect()
    clean = set(range(120))
    assert {r["doc_id"] for r in out} == clean
    by_id = {r[0]: r for r in rows}
    for r in out:
        assert tuple(r)[:5] == by_id[r["doc_id"]]
    shards = collections.defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = [len(shards[i]) for i in range(P.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    copies_of = collections.Counter(r["doc_id"] for r in out)
    assert max(copies_of.values()) <= P.MAX_REPETITION


def test_stage_columns_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    empty = spark.createDataFrame([], DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = empty
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0, name
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_awkward_rows_pass(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13),
            (3, "word of the day is here. " * 4000, "en", None, 1), (4, "plain words of the text", "en", "t", 2), (4, "plain words of the text", "en", "t", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, d)
    assert {r["doc_id"] for r in docs.collect()} >= {2, 3, 4}


def test_near_duplicates_go_by_id_and_text(spark, tmp_path):
    draw = random.Random(3)
    prose = lambda: " ".join(f"w{draw.randrange(4000)}" for _ in range(60))
    one, other, clean = prose(), prose(), prose()
    rows = [
        (1, one), (7, one + " end"), (7, other),  # a near copy of 1 and an unrelated text under one id
        (8, clean), (8, clean + " end"),  # near copies under one id
        (9, None), (9, None), (None, "a b"), (10, one), (11, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert (1, one) in out and (7, other) in out and (7, one + " end") not in out and (10, one) not in out
    assert len([x for x in out if x[0] == 8]) == 1
    assert out.count((9, None)) == 1 and (None, "a b") in out and (11, "") in out
    assert len(out) == 6


def test_stages_carry_extra_columns(spark, tmp_path):
    rows, item, *_ = corpus()
    d = str(tmp_path)
    spark.createDataFrame([("x", item)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    names = ("shard", "slot", "row_no", "quality_score", "quality_keep", "score", "row", "key", "id", "hit", "gone", "found", "mix_key", "a.b", "__src")
    docs = spark.createDataFrame(rows, DOCS)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(100 + k))
    for stage, f in P.STAGES:
        docs = f(spark, docs, d)
        kept = [c for c in names if not (stage == "shard" and c in ("shard", "slot"))]
        assert len(docs.columns) == len(set(docs.columns)) == 5 + len(names)
        for r in docs.collect():
            assert all(r[c] == 100 + names.index(c) for c in kept)


def test_tables_go_when_their_readers_are_done(spark, tmp_path):
    import pathlib

    from lodestar.llm.common import shared_dir

    rows, item, *_ = corpus()
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"), "lodestar")
    before = set(folder.glob("*")) if folder.exists() else set()
    P.run(spark, d).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert left <= {"stage_mix", "shard_rows", "told", "told_bits", "mix_plan"}
