"""The appended index and bounded BM25 against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import bounded, lexical
from lodestar.sources.index_store import IndexStore, Manifest, open_or_create

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]


def chunks(spark, n=400, seed=1, first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        words = [WORDS[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.choice([0, 1, 5, 30]))]
        rows.append((f"c{i:04d}", rng.choice(["", "wa0 title", None]), " ".join(words), n - i))
    return spark.createDataFrame(rows, "chunk_id string, title string, text string, ord int")


def asked(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 8, 20])))) for i in range(25)]
    return spark.createDataFrame(rows + [(90, ""), (91, None), (92, "unknown words"), (93, "wa0 wa0 wa0"), (94, WORDS[59])], "query_id long, text string")


def plain(index, queries, k, order=None):
    return sorted(map(tuple, lexical.top_k(index, queries, k, order).select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bounded_is_the_plain_top_k(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(bounded, "FIRST_WAVE", 3)
    whole, queries = chunks(spark), asked(spark)
    store = IndexStore.create(spark, f"file://{tmp_path}/store", buckets=3)
    store.append(whole)
    for tie, order in (("chunk_id", None), ("ord", whole.select("chunk_id", "ord"))):
        found = bounded.top_k(store, queries, k, tie)
        assert sorted(map(tuple, found.hits.collect())) == plain(lexical.build_index(whole), queries, k, order)
    if k == 1:
        read = found.counts.agg(F.sum("rows_all"), F.sum(F.col("rows_essential") + F.col("rows_first"))).first()
        assert read[1] < read[0]
    monkeypatch.setattr(bounded, "PUSHED_TERMS", 2)
    assert sorted(map(tuple, bounded.top_k(store, queries, k).hits.collect())) == plain(lexical.build_index(whole), queries, k)
    store.close()


def test_appended_compacted_and_built_at_once_agree(spark, tmp_path):
    whole, queries = chunks(spark, 300), asked(spark)
    at_once = lexical.build_index(whole)
    want, terms = plain(at_once, queries, 7), sorted(map(tuple, at_once.terms.collect()))
    path = f"file://{tmp_path}/a store"
    store = open_or_create(spark, path, 3, "m")
    for part in (whole.filter("ord > 250"), whole.filter("ord between 100 and 250"), whole.filter("ord < 100"), whole.limit(0)):
        store.append(part)

    def same():
        again = open_or_create(spark, path, 99, "m")
        assert again.manifest().buckets == 3
        assert sorted(map(tuple, bounded.top_k(again, queries, 7).hits.collect())) == want
        assert plain(again.lexical(), queries, 7) == want and sorted(map(tuple, again.lexical().terms.collect())) == terms
        assert sorted(map(tuple, again.chunks().select(*whole.columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
        again.close()

    same()
    before = IndexStore.open(spark, path)
    old = before.manifest()
    store.compact()
    assert len(store.manifest().segments) == 1
    # a reader of the older version keeps its segments until they are removed
    assert sum(t.count() for t in before.tables("docs", old)) == 300
    assert store.vacuum() == 4
    same()
    with pytest.raises(ValueError, match="index again"):
        IndexStore.open(spark, path, "other")
    with pytest.raises(FileExistsError):
        IndexStore.create(spark, path)
    store.close()


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken commits on top of the other's."""
    path = f"file://{tmp_path}/store"
    IndexStore.create(spark, path, 2)
    one, two = IndexStore.open(spark, path), IndexStore.open(spark, path)
    commit, raced = IndexStore._commit, []

    def late(self, manifest: Manifest) -> bool:
        if self is one and not raced:
            raced.append(1)
            two.append(chunks(spark, 5, first=500))
        return commit(self, manifest)

    monkeypatch.setattr(IndexStore, "_commit", late)
    one.append(chunks(spark, 5))
    held = one.manifest()
    assert held.version == 2 and [s.n_docs for s in held.segments] == [5, 5] and one.chunks().count() == 10
    one.compact()
    assert one.manifest().segments[0].n_docs == 10


def test_embeddings_of_one_dimension(spark, tmp_path):
    store = IndexStore.create(spark, f"file://{tmp_path}/store", 2, "m")
    rows = chunks(spark, 4).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    store.append(rows.withColumn("dl", F.lit("a column of this name gives way")))
    with pytest.raises(ValueError, match="dimension"):
        store.append(rows.withColumn("embedding", F.array(F.lit(1.0))))
    assert store.chunks().count() == 4 and store.manifest().dim == 2


def test_empty_store(spark, tmp_path):
    store = IndexStore.create(spark, f"file://{tmp_path}/store", 2)
    found = bounded.top_k(store, asked(spark), 3)
    assert found.hits.count() == 0 and found.counts.count() == 0 and store.chunks() is None
    with pytest.raises(FileNotFoundError):
        IndexStore.open(spark, f"file://{tmp_path}/nowhere")


def test_joins_leave_the_buckets_where_they_are(spark, tmp_path):
    store = IndexStore.create(spark, f"file://{tmp_path}/store", 4)
    store.append(chunks(spark, 100))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, key in (("postings", "term"), ("blocks", "term"), ("docs", "chunk_id")):
            stored = store.tables(table)[0]
            other = stored.select(key).distinct().filter(F.col(key).isNotNull())
            joined = stored.join(other.withColumn("more", F.lit(1)), key)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pipeline_adds_to_a_store(spark, tmp_path):
    """Documents added in two steps answer like an index of all, and no table is left."""
    from lodestar.plans.pipeline import PRESETS, Pipeline
    from lodestar.session import _written, release

    rows = [(f"d{i:02d}", f"T{i}", f"{'alpha beta gamma' if i % 2 else 'delta epsilon'} number{i} " * 3) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id string, title string, text string")
    queries = spark.createDataFrame([(0, "alpha number3"), (1, "delta number4")], "query_id int, text string")
    pipeline, path = Pipeline(config=PRESETS["hybrid"]), f"file://{tmp_path}/index"
    pipeline.add(docs.filter("doc_id < 'd06'"), path)
    pipeline.add(docs.filter("doc_id >= 'd06'"), path)
    loaded = pipeline.load(spark, path)
    columns = ["query_id", "chunk_id", "doc_id", "rank"]

    def hits(index):
        return sorted((*[r[c] for c in columns], round(r["score"], 9)) for r in pipeline.retrieve(index, queries, 3).collect())

    assert hits(loaded) == hits(pipeline.index(docs))
    with pytest.raises(ValueError, match="index again"):
        Pipeline(config=PRESETS["hybrid"], model="another").load(spark, path)
    folders = [p for held in _written.values() for p in held.paths.values()]
    release(spark)
    assert folders and not any((tmp_path.__class__(p.removeprefix("file://"))).exists() for p in folders)


def test_bounded_writes_hits_and_no_candidates(spark, tmp_path, monkeypatch):
    """However many chunks reach a threshold, a task sends k hits a query; in several blocks of queries too."""
    from lodestar.session import Scratch

    whole, queries, k = chunks(spark), asked(spark), 3
    store = IndexStore.create(spark, f"file://{tmp_path}/store", 2)
    store.append(whole)
    made, cut = {}, Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name: made.setdefault(name, cut(self, df, name)))
    monkeypatch.setattr(Scratch, "close", lambda self, *keep: None)
    monkeypatch.setattr(bounded, "QUERY_BLOCK", 4)
    found = bounded.top_k(store, queries, k)
    assert sorted(map(tuple, found.hits.collect())) == plain(lexical.build_index(whole), queries, k)
    tasks = made["found"].filter("some is not null").count() / max(1, made["judged"].select("query_id").distinct().count())
    assert not {"candidates", "chosen", "scored"} & set(made)
    assert made["found"].filter("some is null").groupBy("query_id").count().agg(F.max("count")).first()[0] <= tasks * k
    assert found.counts.filter("rows_essential > rows_all or rows_scored > rows_all").count() == 0
    store.close()


def test_compaction_deals_no_row_again(spark, tmp_path, monkeypatch):
    """segments are read by bucket as one table, so nothing is shuffled; a bucket stays one file."""
    path = f"file://{tmp_path}/a store"
    store = IndexStore.create(spark, path, 3)
    store.append(chunks(spark, 40))
    store.append(chunks(spark, 40, 2, first=40).withColumn("more", F.lit(1)))
    want = sorted((r["chunk_id"], r["text"], r["ord"], r["more"]) for r in store.chunks().collect())

    def shuffled(self, *args):
        raise AssertionError("rows are dealt again")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "repartition", shuffled)
        store.compact()
    assert sorted((r["chunk_id"], r["text"], r["ord"], r["more"]) for r in store.chunks().collect()) == want
    segment = store.manifest().segments[0].name
    for table in ("docs", "postings", "blocks"):
        assert 1 <= len(list((tmp_path / "a store" / segment / table).glob("*.parquet"))) <= 3, table
    store.append(chunks(spark, 5, 3, first=80).withColumn("more", F.lit(1 << 40)))  # another type: a union, dealt again
    store.compact()
    assert store.chunks().count() == 85 and dict(store.chunks().dtypes)["more"] == "bigint"
    store.close()


def test_a_segment_is_written_without_tables_beside_it(spark, tmp_path, monkeypatch):
    """no table of counts, and a refused segment leaves nothing; postings come a part of the buckets at a time."""
    from lodestar.session import Scratch

    monkeypatch.setattr(Scratch, "cut", lambda *_: pytest.fail("a table beside the segment"))
    store = IndexStore.create(spark, f"file://{tmp_path}/store", 4)
    wrote, write = [], IndexStore._write
    monkeypatch.setattr(IndexStore, "_write", lambda self, df, segment, table, n: (wrote.append(table), write(self, df, segment, table, n)))
    store.append(chunks(spark, 60).withColumn("embedding", F.array(F.lit(1.0))))
    assert wrote.count("postings") == 4 and wrote.count("docs") == wrote.count("blocks") == 1
    with pytest.raises(ValueError, match="dimension"):
        store.append(chunks(spark, 3).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))))
    assert len(list((tmp_path / "store").glob("segment-*"))) == 1
    assert len(list((tmp_path / "store").glob("segment-*/postings/*.parquet"))) <= 4
    store.close()
