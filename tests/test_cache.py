"""The embedding cache: two writers, ranges, compaction; and versions."""

import time

import pytest
from pyspark.sql import functions as F

from lodestar.sources import versions
from lodestar.sources.cache import EmbeddingCache, cache_key, embed_with_cache
from lodestar.sources.versions import Versions


def vectors(spark, first, n, value=1.0):
    rows = spark.range(first, first + n).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    return rows.select(cache_key().alias("key"), F.array(F.lit(value)).alias("embedding"))


def test_two_writers_leave_no_key_twice(spark, tmp_path, monkeypatch):
    one, two = (EmbeddingCache(spark, f"file://{tmp_path}/cache", "m") for _ in range(2))
    commit, raced = Versions.commit, []

    def late(self, version, content):
        if self is one.versions and not raced:
            raced.append(1)
            assert two.put(vectors(spark, 50, 100, 2.0)) == 100
        return commit(self, version, content)

    monkeypatch.setattr(Versions, "commit", late)
    assert one.put(vectors(spark, 0, 100).unionByName(vectors(spark, 0, 100))) == 50
    rows = one.read().collect()
    assert len(rows) == len({r["key"] for r in rows}) == 150
    assert one.put(vectors(spark, 0, 150)) == 0
    assert sum(r["embedding"][0] == 2.0 for r in rows) == 100  # what was first stays
    assert EmbeddingCache(spark, f"file://{tmp_path}/cache", "other").read().count() == 0


def test_lookup_reads_the_ranges_of_its_keys(spark, tmp_path):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", "m")
    cache.put(vectors(spark, 0, 800))
    cache.put(vectors(spark, 800, 400))
    asked = vectors(spark, 795, 10).select("key")
    found = cache.read(asked)
    assert found.count() == 10
    ranges = {k["key"][:2] for k in asked.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "embedding" in x.split("ReadSchema")[1]]
    assert len(scans) == 2 and len(ranges) <= 10
    for scan in scans:
        told = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert "range" in told and all(r in told for r in ranges) and "not" not in told.split("IN")[0]


def test_compaction_keeps_every_row(spark, tmp_path):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", "m")
    for i in range(3):
        cache.put(vectors(spark, 30 * i, 40, float(i)))
    before = sorted((r["key"], r["embedding"][0]) for r in cache.read().collect())
    reader = cache.read()
    cache.compact()
    assert len(cache._live()[1]) == 1 and sorted((r["key"], r["embedding"][0]) for r in cache.read().collect()) == before
    assert reader.count() == 100  # an older version is still there
    assert cache.vacuum() >= 3 and sorted((r["key"], r["embedding"][0]) for r in cache.read().collect()) == before


def test_texts_are_embedded_once(spark, tmp_path):
    asked = []

    def embed(texts):
        asked.extend(r["text"] for r in texts.collect())
        return texts.select("id", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("embedding"))

    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id int, text string")
    for _ in range(2):
        got = {r["id"]: r["embedding"] for r in embed_with_cache(texts, f"file://{tmp_path}/c", "m", embed).collect()}
        assert got == {1: [1.0], 2: [2.0], 3: [1.0], 4: [0.0], 5: [0.0]}
    assert sorted(x or "" for x in asked) == ["", "a", "bb"]


def test_a_claim_without_a_version_goes_stale(spark, tmp_path, monkeypatch):
    held = Versions(spark, f"file://{tmp_path}/versions")
    assert held.latest() is None and held.commit(0, {"x": 0}) and not held.commit(0, {"x": 1})
    system, claim = held.file(f"{1:010d}.claim")
    system.createNewFile(claim)  # a writer that died
    assert not held.commit(1, {"x": 1}) and held.latest() == {"x": 0}
    monkeypatch.setattr(versions, "STALE_SECONDS", 0.5)
    time.sleep(1.2)
    assert held.commit(1, {"x": 1}) and held.latest() == {"x": 1}
    with pytest.raises(Exception):
        Versions(spark, "nowhere://x/y").latest()
