"""k-means against numpy, and its cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cluster
from lodestar.session import Scratch


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "id long, embedding array<double>")


def groups(n, k, d=8, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(k, d))
    return middles[np.arange(n) % k] + rng.normal(size=(n, d)) * 0.05


def by_hand(rows, centres, rounds):
    labels = None
    for _ in range(rounds):
        fresh = cluster.distances(rows, centres).argmin(axis=1)
        if labels is not None and (fresh == labels).all():
            break
        labels = fresh
        centres = np.stack([rows[labels == j].mean(axis=0) if (labels == j).any() else centres[j] for j in range(len(centres))])
    return labels


@pytest.mark.parametrize("rounds", [1, 3, 30])
def test_rounds_from_given_centres(spark, rounds):
    rows = groups(300, 7)
    start = np.vstack([rows[:5], -rows[:1]])
    got = dict(cluster.kmeans(frame(spark, rows).repartition(5), 0, rounds, start=start.tolist()).collect())
    assert [got[i] for i in range(300)] == by_hand(rows, start, rounds).tolist()


def test_seeds_find_every_group(spark):
    """k-means|| with its reduction hits all of 40 far groups, also where one holds a third of all rows."""
    rows = np.vstack([groups(400, 40), np.tile(groups(1, 1)[0], (200, 1))])
    got = dict(cluster.kmeans(frame(spark, rows).repartition(6), 40).collect())
    parts = {}
    for i in range(400):
        parts.setdefault(i % 40, set()).add(got[i])
    assert sum(len(p) == 1 for p in parts.values()) >= 38 and len({x for p in parts.values() for x in p}) >= 38


def test_awkward_vectors(spark):
    rows = [None, [], [0, 0], [1, 0], [1, 0], [0, 1], [0.5], [float(2), 0]]
    got = dict(cluster.kmeans(frame(spark, rows), 2).collect())
    assert len(got) == 8 and got[3] == got[4] == got[6] == got[7] != got[5]
    assert cluster.kmeans(frame(spark, [None, None]), 2).count() == 2
    with pytest.raises(ValueError, match="centres"):
        cluster.kmeans(frame(spark, rows), 0, start=[[1.0, 0.0]] * (cluster.FAN + 1))


def test_cells(spark, monkeypatch):
    """Small limits: several levels, salted cells, a third of the rows the same vector."""
    monkeypatch.setattr(cluster, "FAN", 8)
    monkeypatch.setattr(cluster, "LEAF", 40)
    monkeypatch.setattr(cluster, "SAMPLE", 40)
    monkeypatch.setattr(cluster, "SPLIT_ROWS", 100)
    rows = np.vstack([groups(600, 60), np.tile([1.0] * 8, (300, 1))])
    df = frame(spark, rows).repartition(7)
    base = df.select(F.xxhash64("id").alias("h"), F.lit(0).cast("long").alias("h2"), F.lit(1).cast("long").alias("n"), "embedding")
    scratch = Scratch(spark)
    sizes = [r["count"] for r in cluster.cells(base, 8, scratch).groupBy("cell").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 40 and len(sizes) < 300
    scratch.close()
    assert not scratch.paths
    got = dict(cluster.kmeans(df, 90).collect())
    assert len(got) == 900 and sorted(set(got.values())) == list(range(max(got.values()) + 1)) and 70 <= len(set(got.values())) <= 110 and len({got[i] for i in range(600, 900)}) == 1

    def cost(labels):
        labels = np.array(labels)
        return sum(float(cluster.distances(rows[labels == j], rows[labels == j].mean(axis=0)[None]).sum()) for j in set(labels.tolist()))

    assert cost([got[i] for i in range(900)]) < 3 * cost(cluster.lloyd(rows, 90, 30)[0]) + 1
    one = dict(cluster.kmeans(df.limit(30), 9).collect())
    assert len(one) == 30


def test_number_of_passes_does_not_grow_with_clusters(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LEAF", 500)
    rows = groups(4000, 900, d=4)
    df = frame(spark, rows).repartition(4).persist()
    df.count()
    tracker, seen = spark.sparkContext.statusTracker(), {}
    for k in (300, 1500):
        spark.sparkContext.setJobGroup(f"k{k}", "kmeans")
        cluster.kmeans(df, k).count()
        seen[k] = len(tracker.getJobIdsForGroup(f"k{k}"))
    spark.sparkContext.setJobGroup("other", "other")
    df.unpersist()
    assert seen[1500] == seen[300] < 50, seen


def test_assign_in_blocks(spark):
    rows = groups(60, 12)
    df = frame(spark, rows)
    centres = df.filter("id < 30").select(F.col("id").cast("int").alias("label"), F.col("embedding").alias("centre"))
    want = cluster.distances(rows, rows[:30]).argmin(axis=1).tolist()
    for block in (7, 100):
        got = {r["id"]: r["label"] for r in cluster.assign(df, centres, block).collect()}
        assert [got[i] for i in range(60)] == want
    assert math.isclose(cluster.distances(np.array([[0.0, 0.0]]), np.array([[1.0, 0.0]]))[0, 0], 1.0)


def test_members_of_a_summary_come_in_the_order_of_insertion(spark):
    rows = [(f"d#{i}", "d", "t", i, f"same words again {'x' * i}") for i in (10, 2, 9, 11, 100, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, title string, position int, text string")
    from lodestar.operators import tree
    from lodestar.plans.pipeline import hash_embed

    nodes = tree.build_tree(chunks, hash_embed, levels=1, cluster_size=3)
    for r in nodes.filter("level = 1").collect():
        places = [int(c.split("#")[1]) for c in r["children"]]
        assert places == sorted(places)
