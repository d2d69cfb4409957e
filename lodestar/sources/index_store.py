"""A chunk index in immutable segments that grows by appending.

A store is a folder: segments with their tables, and versions of a manifest that names the
live segments with their totals. ``append`` writes a segment and commits a new version; a
version is created exclusively, so of two writers one repeats its commit on top of the other's.
``compact`` makes one segment of all; readers of an older version keep theirs until ``vacuum``.

Tables of a segment, Parquet in BUCKETS buckets, each sorted, so joins on the bucket column
need no exchange on this side:

- ``docs`` by chunk_id: the chunks with ``dl`` (tokens), ``block``, ``tfs`` (their terms with counts, so
  a chunk can be scored without its terms' postings) and whatever columns they had;
- ``postings`` by term: term, block, chunk_id, tf, dl;
- ``blocks`` by term: for each run of BLOCK_CHUNKS chunks how many hold the term, the most often
  it occurs in one and the shortest length among them, which bounds every score of the block.

A segment is written without tables beside it: texts are dealt into the buckets and tokenised
there, postings are read from ``docs`` and dealt WAVES shuffles after another, what is bucketed
already (the postings that ``blocks`` adds up, the segments that are compacted) is not dealt again.

What depends on the whole collection (document frequencies, mean length) is added up over the
live segments when it is read, so an appended index scores like one built at once.

Cases: a store without segments answers nothing; chunks without tokens count in the number and
mean length; a column of embeddings must have one dimension in the whole store and one model
(ValueError). Chunk ids are the caller's to keep apart: a chunk appended twice is there twice.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.lexical import LexicalIndex, B, K1, chunk_counts
from lodestar.session import SHUFFLES_REMOVED, prepare, settings
from lodestar.sources.versions import Versions

PART = "__segment"  # the place of a segment, where several are read as one table
BLOCK_BITS = 5
BLOCK_CHUNKS = 1 << BLOCK_BITS
TABLES = {"docs": "chunk_id", "postings": "term", "blocks": "term"}
SORTED = {"docs": ["chunk_id"], "postings": ["term", "block"], "blocks": ["term", "block"]}
MADE = ("dl", "block", "tfs")  # columns of docs made here; a chunk's own of these names give way
ATTEMPTS = 20
WAVES = 4  # shuffles that a segment's postings are dealt in, each gone before the next
#: a bucketed table is read a bucket a task, whatever is done with it
BY_BUCKET = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@dataclass(frozen=True)
class Segment:
    name: str
    n_docs: int
    total_length: int
    schemas: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    model: str | None
    dim: int | None
    segments: tuple[Segment, ...] = ()


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path.rstrip("/")
        self._versions = Versions(spark, f"{self.path}/manifest")
        self._registered: dict[tuple[str, str], str] = {}

    # --- manifest -------------------------------------------------------------

    def manifest(self) -> Manifest:
        held = self._versions.latest()
        if held is None:
            raise FileNotFoundError(f"no index store in {self.path}")
        held["segments"] = tuple(Segment(**s) for s in held["segments"])
        return Manifest(**held)

    def _commit(self, manifest: Manifest) -> bool:
        """Whether this version is ours: another writer may have made it first."""
        return self._versions.commit(manifest.version, asdict(manifest))

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 32, model: str | None = None) -> IndexStore:
        store = cls(spark, path)
        if not store._commit(Manifest(0, buckets, model, None)):
            raise FileExistsError(f"there is an index store in {path}")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, model: str | None = None) -> IndexStore:
        """ValueError when another embedder made the store; told by its manifest, without a scan."""
        store = cls(spark, path)
        made = store.manifest().model
        if model is not None and made is not None and model != made:
            raise ValueError(f"the index was made with {made!r}, not {model!r}: index again")
        return store

    # --- tables ---------------------------------------------------------------

    def _write(self, dealt: DataFrame, segment: str, table: str, buckets: int) -> None:
        """Rows dealt into the buckets, sorted, a file each, as a table of this session; another call
        adds further buckets."""
        key, name = TABLES[table], self._registered.get((segment, table), f"lodestar_{uuid.uuid4().hex}")
        writer = dealt.sortWithinPartitions(*SORTED[table]).write.format("parquet").mode("append")
        writer = writer.bucketBy(buckets, key).sortBy(*SORTED[table]).option("compression", "zstd")
        with settings(self.spark, SHUFFLES_REMOVED | BY_BUCKET):
            writer.option("path", f"{self.path}/{segment}/{table}").saveAsTable(name)
        self._registered[segment, table] = name

    def table(self, segment: Segment, table: str, buckets: int) -> DataFrame:
        key = (segment.name, table)
        if key not in self._registered:
            name = f"lodestar_{uuid.uuid4().hex}"
            sort = ", ".join(SORTED[table])
            self.spark.sql(
                f"CREATE TABLE {name} ({segment.schemas[table]}) USING parquet CLUSTERED BY ({TABLES[table]}) SORTED BY ({sort}) "
                f"INTO {buckets} BUCKETS LOCATION '{self.path}/{segment.name}/{table}'"
            )
            self._registered[key] = name
        return self.spark.table(self._registered[key])

    def tables(self, name: str, manifest: Manifest | None = None) -> list[DataFrame]:
        """The table of every live segment."""
        held = manifest or self.manifest()
        return [self.table(s, name, held.buckets) for s in held.segments]

    def close(self) -> None:
        """Forget this session's table names; the files stay."""
        for name in self._registered.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._registered.clear()

    # --- writing --------------------------------------------------------------

    def _segment(self, name: str, buckets: int) -> Segment:
        """The segment whose docs and postings are written: its blocks and what the manifest says of it."""
        held = self.spark.table(self._registered[name, "postings"])
        blocks = held.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf_max"), F.min("dl").alias("dl_min"))
        self._write(blocks, name, "blocks", buckets)
        n, total = self.spark.table(self._registered[name, "docs"]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        schemas = {t: ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in self.spark.table(self._registered[name, t]).schema) for t in TABLES}
        return Segment(name, n, total, schemas)

    def _discard(self, name: str) -> None:
        """A segment that was not committed."""
        for key in [k for k in self._registered if k[0] == name]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._registered.pop(key)}")
        system, manifest = self._versions.file("")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(manifest.getParent(), name)
        system.delete(path, True)

    def append(self, chunks: DataFrame, exact: bool = False) -> Segment:
        """A new segment of chunks(chunk_id, title, text, ...); other columns are kept."""
        before, name = self.manifest(), f"segment-{uuid.uuid4().hex}"
        whole = F.struct(*[F.col(f"`{c}`") for c in chunks.columns]).alias("row")
        block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")
        dealt = chunks.select(whole, block).repartition(before.buckets, "row.chunk_id")  # before they are tokenised: texts alone
        counts = chunk_counts(dealt.withColumns({c: F.col(f"row.{c}") for c in ("title", "text")}), exact, keep=("row", "block"))
        own = [F.col(f"row.`{c}`").alias(c) for c in chunks.columns if c not in MADE]
        self._write(counts.select(*own, *MADE), name, "docs", before.buckets)
        docs = self.spark.table(self._registered[name, "docs"])
        dim = before.dim
        if "embedding" in chunks.columns:
            sizes = [r[0] for r in docs.select(F.size("embedding").alias("d")).distinct().limit(2).collect()]
            if len(sizes) > 1 or (dim is not None and sizes and sizes[0] != dim):
                self._discard(name)
                raise ValueError(f"embeddings must have one dimension{f', {dim} here' if dim else ''}, not {sizes}")
            dim = sizes[0] if sizes else dim
        postings = docs.select("block", "chunk_id", "dl", F.explode("tfs").alias("e")).select("e.term", "block", "chunk_id", "e.tf", "dl")
        waves = min(WAVES, before.buckets)
        for wave in range(waves):  # by bucket, so a bucket is one file
            mine = F.pmod(F.hash("term"), F.lit(before.buckets)) % waves == wave
            self._write(postings.filter(mine).repartition(before.buckets, "term"), name, "postings", before.buckets)
        made = self._segment(name, before.buckets)
        for _ in range(ATTEMPTS):
            live = self.manifest()
            if live.dim is not None and dim != live.dim:
                raise ValueError(f"embeddings must have one dimension, {live.dim} here, not {dim}")
            if self._commit(Manifest(live.version + 1, live.buckets, live.model, dim, (*live.segments, made))):
                return made
        raise RuntimeError("other writers kept committing first")

    @contextmanager
    def _together(self, table: str, held: Manifest):
        """A table of all live segments, dealt as they are, with PART, the place of a row's segment."""
        parts = self.tables(table, held)
        kinds = {}
        for p in parts:
            for c in p.schema:
                kinds.setdefault(c.name, set()).add(c.dataType.simpleString())
        if any(len(k) > 1 for k in kinds.values()):  # a union finds a common type, and knows no buckets
            whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.withColumn(PART, F.lit(i)) for i, p in enumerate(parts)])
            yield whole.repartition(held.buckets, TABLES[table])
            return
        name, columns = f"lodestar_{uuid.uuid4().hex}", ", ".join(f"`{c}` {k}" for c, (k,) in kinds.items())
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, {PART} INT) USING parquet PARTITIONED BY ({PART}) CLUSTERED BY ({TABLES[table]}) "
            f"INTO {held.buckets} BUCKETS LOCATION '{self.path}/together-{name}'"
        )
        for i, s in enumerate(held.segments):
            self.spark.sql(f"ALTER TABLE {name} ADD PARTITION ({PART} = {i}) LOCATION '{self.path}/{s.name}/{table}'")
        try:
            yield self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def compact(self) -> None:
        """One segment of all live ones. Segments appended meanwhile stay beside it."""
        before = self.manifest()
        if len(before.segments) < 2:
            return
        name = f"segment-{uuid.uuid4().hex}"
        for table in ("docs", "postings"):
            with self._together(table, before) as whole:
                self._write(whole.withColumn("block", F.col("block") + F.shiftleft(F.col(PART).cast("long"), 48)).drop(PART), name, table, before.buckets)
        made = self._segment(name, before.buckets)
        gone = {s.name for s in before.segments}
        for _ in range(ATTEMPTS):
            live = self.manifest()
            if not gone <= {s.name for s in live.segments}:
                return  # another compaction was first
            rest = tuple(s for s in live.segments if s.name not in gone)
            if self._commit(Manifest(live.version + 1, live.buckets, live.model, live.dim, (made, *rest))):
                return
        raise RuntimeError("other writers kept committing first")

    def vacuum(self) -> int:
        """Remove segments that the latest version does not name; how many. Not to be run
        while a writer is at work, whose segment is not committed yet."""
        live = {s.name for s in self.manifest().segments}
        system, manifest = self._versions.file("")
        folder = manifest.getParent()
        gone = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("segment-") and s.getPath().getName() not in live]
        for path in gone:
            system.delete(path, True)
        for key in [k for k in self._registered if k[0] not in live]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._registered.pop(key)}")
        return len(gone)

    # --- reading --------------------------------------------------------------

    def totals(self, manifest: Manifest | None = None) -> tuple[int, float]:
        """(chunks, mean length), from the manifest."""
        held = (manifest or self.manifest()).segments
        n = sum(s.n_docs for s in held)
        return n, (sum(s.total_length for s in held) / n if n else 0.0)

    def chunks(self) -> DataFrame | None:
        """All chunks with their columns; None in an empty store."""
        whole = None
        for part in self.tables("docs"):
            part = part.drop(*MADE)
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
        return whole

    def lexical(self, k1: float = K1, b: float = B) -> LexicalIndex:
        """The index tables of all live segments as one, for the plain operators."""
        held = self.manifest()
        n, mean = self.totals(held)
        def union(name: str, *columns: str) -> DataFrame:
            whole = None
            for part in self.tables(name, held):
                whole = part.select(*columns) if whole is None else whole.unionByName(part.select(*columns))
            return whole
        corpus = self.spark.createDataFrame([(n, mean)], "n_docs long, avgdl double")
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        terms = union("blocks", "term", "n").groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", idf)
        ratio = F.col("dl") / F.lit(mean) if mean > 0 else F.lit(0.0)
        lengths = union("docs", "chunk_id", "dl").withColumn("norm", F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * ratio))
        ordered = [c for c in ("ord",) if all(c in t.columns for t in self.tables("docs", held))]
        counts = union("docs", "chunk_id", *ordered, "dl", "tfs")
        return LexicalIndex(union("postings", "term", "chunk_id", "tf"), lengths, terms, corpus, k1, b, counts)


def has_store(spark: SparkSession, path: str) -> bool:
    """Whether a store with at least one segment is there."""
    try:
        return bool(IndexStore(spark, path).manifest().segments)
    except FileNotFoundError:
        return False


def open_or_create(spark: SparkSession, path: str, buckets: int = 32, model: str | None = None) -> IndexStore:
    try:
        return IndexStore.open(spark, path, model)
    except FileNotFoundError:
        return IndexStore.create(spark, path, buckets, model)
