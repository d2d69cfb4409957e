"""Embedding cache: a table of (key, embedding) in key ranges, with versions.

A key is the start of the text's SHA-256 digest; its first two digits are its range. Every
``put`` writes a batch, partitioned by range, and commits a version that names it. Of two
writers that met the same texts the later one finds the other's version, drops the keys that
are there by now and commits the rest: no key is ever there twice. A lookup reads the ranges
of its keys alone, and of these, by the sorted files' statistics, few row groups. ``compact``
makes one batch of all; ``vacuum`` removes batches that the latest version does not name.

Cases: a cache that is not there is empty; a null text counts as empty; texts that repeat are
looked up once each and kept once; a null embedding is not kept. The folder is a partitioned
Parquet table (model, batch, range), which any reader may open; versions lie in a hidden folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import Scratch, prepare, written
from lodestar.sources.versions import Versions

SCHEMA = "key string, embedding array<double>, range string"
RANGE_CHARS = 2
ATTEMPTS = 20


def cache_key(text: str = "text") -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)


def _range(key: str = "key") -> Column:
    return F.substring(key, 1, RANGE_CHARS)


class EmbeddingCache:
    """The cache of one model in a folder."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path = prepare(spark), f"{path.rstrip('/')}/model={model}"
        self.versions = Versions(spark, f"{self.path}/_versions")

    def _live(self) -> tuple[int, list[str]]:
        held = self.versions.latest()
        return (held["version"], held["batches"]) if held else (-1, [])

    def _batches(self, names: list[str], ranges: list[str] | None = None) -> DataFrame:
        whole = self.spark.createDataFrame([], SCHEMA)
        for name in names:
            part = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
            whole = whole.unionByName(part if ranges is None else part.filter(F.col("range").isin(ranges)))
        return whole

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, embedding) of the whole cache, or of ``keys`` (key): then only their ranges,
        256 at most, are read."""
        names = self._live()[1]
        if keys is None:
            return self._batches(names).select("key", "embedding")
        ranges = sorted(r[0] for r in keys.select(_range()).distinct().collect())
        return self._batches(names, ranges).join(keys.select("key").distinct(), "key", "left_semi").select("key", "embedding")

    def _write(self, rows: DataFrame) -> str:
        name = f"batch={uuid.uuid4().hex}"
        dealt = rows.withColumn("range", _range()).select("key", "embedding", "range").repartition("range").sortWithinPartitions("range", "key")
        dealt.write.partitionBy("range").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def put(self, rows: DataFrame) -> int:
        """Keep rows(key, embedding) whose keys are not there; how many."""
        scratch = Scratch(self.spark)
        once = scratch.cut(rows.filter("embedding is not null").dropDuplicates(["key"]), "batch")
        try:
            for _ in range(ATTEMPTS):
                version, names = self._live()
                fresh = once.join(self.read(once), "key", "left_anti") if names else once
                name = self._write(fresh)
                n = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").count()
                if n and self.versions.commit(version + 1, {"version": version + 1, "batches": [*names, name]}):
                    return n
                self._remove(name)
                if not n:
                    return 0
            raise RuntimeError("other writers kept committing first")
        finally:
            scratch.close()

    def compact(self) -> None:
        version, names = self._live()
        if len(names) < 2:
            return
        name = self._write(self._batches(names))
        for _ in range(ATTEMPTS):
            now, live = self._live()
            if not set(names) <= set(live):
                return  # another compaction was first
            if self.versions.commit(now + 1, {"version": now + 1, "batches": [name, *(x for x in live if x not in names)]}):
                return
        raise RuntimeError("other writers kept committing first")

    def vacuum(self) -> int:
        """Remove batches that no version in use names; not to be run while a writer is at work."""
        live = set(self._live()[1])
        system, own = self.versions.file("")
        names = [s.getPath().getName() for s in system.listStatus(own.getParent())]
        gone = [n for n in names if n.startswith("batch=") and n not in live]
        for name in gone:
            self._remove(name)
        return len(gone)

    def _remove(self, name: str) -> None:
        system, path = self.versions.file(f"../{name}")
        system.delete(path, True)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text): each text that the cache lacks, once."""
    keyed = texts.select(cache_key().alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def embed_with_cache(texts: DataFrame, path: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, embedding) of texts(id, text): only what the model's cache lacks is computed.

    ``embed`` maps (id, text) to (id, embedding).
    """
    cache = EmbeddingCache(texts.sparkSession, path, model)
    keyed = written(texts.select("id", "text", cache_key().alias("key")), "keyed")
    missing = cache_misses(keyed.select("text"), cache.read(keyed))
    cache.put(embed(missing.select(F.col("key").alias("id"), "text")).select(F.col("id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding")))
    return keyed.select("id", "key").join(cache.read(keyed), "key").select("id", "embedding")
