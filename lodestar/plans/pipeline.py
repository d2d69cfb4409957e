"""Retrieval pipelines: configuration in, one lazy plan over a batch of queries out."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.operators import dense, embed, expansion, fusion, lexical, metrics, ordering, reflect, rerank, tree
from lodestar.operators.chunking import chunk_documents
from lodestar.session import prepare, written
from lodestar.sources import readers
from lodestar.sources.index_store import IndexStore, has_store, open_or_create
from lodestar.sources.providers import ChatProvider, LocalChat, OpenAICompatibleChat, OpenAICompatibleEmbedder, embed_texts

LOCAL_MODEL = f"hash-{embed.DIM}"


@dataclass(frozen=True)
class Settings:
    """Parameters with their defaults; ``from_env`` takes the environment into account."""

    chunk_size: int = 600
    overlap: int = 100
    top_k: int = 4
    temperature: float = 0.0
    max_tokens: int = 600
    candidates: int = 20
    dense_weight: float = 0.5
    rrf_k: int = 60
    hyde_n: int = 1
    rewrites: int = 3
    tree_levels: int = 2
    cluster_size: int = 5
    hyde_temperature: float = 0.7
    chat_model: str = ""
    embedding_model: str = ""
    embedding_provider: str = "local"  # or "openrouter", for any OpenAI-compatible gateway

    @classmethod
    def from_env(cls) -> Settings:
        names = {
            "chunk_size": "CHUNK_SIZE", "overlap": "CHUNK_OVERLAP", "top_k": "TOP_K", "temperature": "TEMPERATURE",
            "max_tokens": "MAX_TOKENS", "candidates": "CANDIDATOS", "dense_weight": "PESO_DENSO", "rrf_k": "RRF_K",
            "hyde_n": "HYDE_N", "rewrites": "N_REESCRITAS", "tree_levels": "RAPTOR_NIVEIS", "cluster_size": "RAPTOR_TAMANHO_CLUSTER",
            "hyde_temperature": "HYDE_TEMPERATURA", "chat_model": "MODEL", "embedding_model": "EMBEDDING_MODEL",
            "embedding_provider": "EMBEDDING_PROVIDER",
        }
        base = cls()
        return replace(base, **{k: type(getattr(base, k))(os.environ[v]) for k, v in names.items() if os.environ.get(v)})


@dataclass(frozen=True)
class Config:
    """Which techniques a run uses."""

    hybrid: bool = True
    fusion: str = "rrf"  # or "weighted", for exactly two rankings
    hyde: bool = False
    rewrite: str = ""
    rerank: str = ""
    relevance_filter: bool = False
    order: str = "edges"
    retrieve_on_demand: bool = False
    critique: bool = False

    def active(self) -> list[str]:
        names = [
            (self.hybrid, f"hybrid({self.fusion})"), (self.hyde, "HyDE"), (bool(self.rewrite), f"rewrite({self.rewrite})"),
            (bool(self.rerank), f"rerank({self.rerank})"), (self.relevance_filter, "IsREL"), (self.retrieve_on_demand, "Retrieve"),
            (self.critique, "IsSUP/IsUSE"), (True, f"order({self.order})"),
        ]
        return [n for on, n in names if on]


PRESETS = {
    "basic": Config(hybrid=False, order="descending"),
    "hybrid": Config(),
    "hyde": Config(hyde=True),
    "rerank": Config(rerank="pointwise"),
    "full": Config(
        hyde=True, rewrite="multi_query", rerank="pointwise", relevance_filter=True, retrieve_on_demand=True, critique=True
    ),
}


def hash_embed(texts: DataFrame) -> DataFrame:
    """(id, embedding) of (id, text) by the hashing embedder."""
    return embed.packed_vectors(texts, "id", "text")


KEY_VARIABLE, URL_VARIABLE = "OPENROUTER_API_KEY", "OPENAI_BASE_URL"


def make_embedder(settings: Settings, cache: str | None = None) -> tuple[Callable[[DataFrame], DataFrame], str]:
    """(embed, model name) as the settings choose; with ``cache``, a folder, texts that it
    holds are not embedded again. ``embed`` maps (id, text) to (id, embedding)."""
    base, model = hash_embed, LOCAL_MODEL
    if settings.embedding_provider.lower() == "openrouter":
        if not settings.embedding_model:
            raise ValueError("name an embedding model")
        remote = OpenAICompatibleEmbedder(settings.embedding_model, os.environ.get(URL_VARIABLE), KEY_VARIABLE)
        base, model = (lambda texts: embed_texts(texts, remote, "id")), remote.name
    if not cache:
        return base, model
    return (lambda texts: readers.embed_with_cache(texts, cache, model, base)), model


def make_provider(settings: Settings) -> ChatProvider:
    """The chat model that the settings name, or the local stand-in."""
    if settings.embedding_provider.lower() == "openrouter" and settings.chat_model:
        return OpenAICompatibleChat(settings.chat_model, os.environ.get(URL_VARIABLE), KEY_VARIABLE)
    return LocalChat()


def insertion_order(doc_id: Column, position: Column, integral: bool) -> Column:
    """A string that sorts chunks by document and place, numbers by value."""
    shifted = (doc_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string") if integral else doc_id.cast("string")
    return F.concat(F.lpad(shifted, 20, "0") if integral else shifted, F.lit("\x01"), F.lpad(position.cast("string"), 10, "0"))


@dataclass
class Index:
    """chunks with embeddings, and the lexical tables.

    ``docs``, cut by ``strategy``, is there where chunks and vectors are no table but made from it
    whenever they are read.
    """

    chunks: DataFrame
    lexical: lexical.LexicalIndex | None
    model: str = LOCAL_MODEL
    docs: DataFrame | None = None
    strategy: str = "recursive"


BROADCAST_HITS = 200_000  # hits up to which the chunks are looked through for them, unshuffled


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits, which come from a table of rankings, with the columns of chunks(chunk_id, ...)."""
    small = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    return (F.broadcast(hits) if small else hits).join(chunks, "chunk_id")


LEXICAL = 1000  # lexical rankings come after every dense one
SETTLE_SECONDS = 2.0  # counts arrive shortly after the action that made them


class Trace:
    """What a run passed on at each stage, counted while it runs: no further jobs.

    ``watch`` adds counts to a frame as an observation. Once the run's result has been written
    or shown, ``rows`` gives (stage, rows, more) in the order of the stages, and ``row`` all of
    it as one row with the seconds since the trace was made. A stage that did not run is
    missing. ``more`` holds what else a stage counts: kept and dropped hits, abstentions and the
    calls that a model was asked for.
    """

    def __init__(self) -> None:
        self.began = time.monotonic()
        self.stages: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        seen = self.stages[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in more.items()])

    def rows(self) -> list[tuple[str, int, dict[str, int]]]:
        found, until = [], time.monotonic() + SETTLE_SECONDS
        for stage, seen in self.stages.items():
            # a stage that never ran (its frame was not needed) would be waited for without end
            while not (ran := seen._jo is not None and seen._jo.future().isCompleted()) and time.monotonic() < until:
                time.sleep(0.05)
            if ran:
                got = dict(seen.get)
                found.append((stage, got.pop("rows"), got))
        return found

    def row(self, spark) -> DataFrame:
        seconds, found = time.monotonic() - self.began, self.rows()
        calls = sum(more.get("calls", 0) for _, _, more in found)
        schema = "stages array<struct<stage: string, rows: bigint, more: map<string, bigint>>>, model_calls bigint, seconds double"
        return spark.createDataFrame([(found, calls, seconds)], schema)


@dataclass
class Pipeline:
    settings: Settings = field(default_factory=Settings)
    config: Config = field(default_factory=Config)
    provider: ChatProvider = field(default_factory=LocalChat)
    embedder: object = hash_embed
    model: str = LOCAL_MODEL
    trace: Trace | None = None

    def _watch(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        return df if self.trace is None else self.trace.watch(df, stage, **more)

    @classmethod
    def of(cls, settings: Settings, config: Config, cache: str | None = None) -> Pipeline:
        """Provider and embedder as the settings choose."""
        embedder, model = make_embedder(settings, cache)
        return cls(settings, config, make_provider(settings), embedder, model)

    def chunks(self, docs: DataFrame, strategy: str = "recursive", with_tree: bool = False) -> DataFrame:
        """Chunks of documents(doc_id, title, text) with ``ord``, without embeddings."""
        prepare(docs.sparkSession)
        keep = tuple(c for c in ("origin",) if c in docs.columns)
        chunks = chunk_documents(docs, strategy, self.settings.chunk_size, self.settings.overlap, keep=keep)
        integral = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
        chunks = chunks.withColumn("ord", insertion_order(F.col("doc_id"), F.col("position"), integral))
        chunks = chunks.withColumn("doc_id", F.col("doc_id").cast("string"))
        if with_tree:
            nodes = tree.build_tree(chunks, self.embedder, self.settings.tree_levels, self.settings.cluster_size, self.provider)
            # summaries come after the chunks, level by level
            order = insertion_order(F.col("level"), F.col("position"), True)
            chunks = nodes.join(chunks.select("chunk_id", F.col("ord").alias("own")), "chunk_id", "left").select(
                "chunk_id", "doc_id", "title", "position", "text", "level", "doc_ids",
                F.coalesce(F.concat(F.lit("0"), F.col("own")), F.concat(F.lit("1"), order)).alias("ord"),
            )
        return chunks

    def embedded(self, chunks: DataFrame) -> DataFrame:
        if self.embedder is hash_embed:  # made in the chunk's own row
            return chunks.withColumn("embedding", embed.dense_column(F.col("text")))
        vectors = self.embedder(chunks.select(F.col("chunk_id").alias("id"), "text")).withColumnRenamed("id", "chunk_id")
        return chunks.join(vectors, "chunk_id")

    def index(self, docs: DataFrame, strategy: str = "recursive", with_tree: bool = False) -> Index:
        """Index tables of documents(doc_id, title, text)."""
        chunks = self.chunks(docs, strategy, with_tree)
        made = Index(self.embedded(chunks), lexical.build_index(chunks), self.model)
        return made if with_tree or self.embedder is not hash_embed else replace(made, docs=docs, strategy=strategy)

    def add(self, docs: DataFrame, path: str, strategy: str = "recursive") -> IndexStore:
        """Append documents to the store at ``path``, which is made if it is not there.

        Only the new documents are read, embedded and indexed. ``ord`` keeps the order of
        insertion: segments by version, then document and place.
        """
        store = open_or_create(docs.sparkSession, path, model=self.model)
        place = F.lit(f"{store.manifest().version:010d}/")
        store.append(self.embedded(self.chunks(docs, strategy).withColumn("ord", F.concat(place, "ord"))))
        return store

    def stored(self, store: IndexStore) -> Index:
        """The live segments of a store as one index."""
        return Index(store.chunks(), store.lexical(), self.model)

    def save(self, index: Index, path: str) -> None:
        readers.write_index(index.chunks, f"{path}/chunks", index.model)
        index.lexical.write(f"{path}/lexical")

    def load(self, spark, path: str) -> Index:
        """A saved index; ValueError when another embedder made it."""
        prepare(spark)
        if has_store(spark, path):
            return self.stored(IndexStore.open(spark, path, self.model))
        return Index(readers.read_index(spark, f"{path}/chunks", self.model), lexical.LexicalIndex.read(spark, f"{path}/lexical"), self.model)

    def _query_vectors(self, texts: DataFrame) -> DataFrame:
        """(query_id, variant_no, embedding): hypothetical documents serve the first variant only."""
        keyed = texts.withColumn("id", F.concat_ws("/", F.col("query_id").cast("string"), F.col("variant_no").cast("string")))
        plain = keyed.join(self.embedder(keyed.select("id", "text")), "id").select("query_id", "variant_no", "embedding")
        if not self.config.hyde:
            return plain
        first = texts.filter("variant_no = 0").select("query_id", "text")
        hypothetical = expansion.hypothetical_documents(first, self.settings.hyde_n, provider=self.provider, temperature=self.settings.hyde_temperature)
        mean = expansion.hyde_vectors(first, hypothetical, self.embedder).select("query_id", F.lit(0).alias("variant_no"), "embedding")
        return mean.unionByName(plain.filter("variant_no > 0"))

    def variants(self, queries: DataFrame) -> DataFrame:
        """(query_id, variant_no, text): each query, and its rewrites."""
        if not self.config.rewrite:
            return queries.select("query_id", F.lit(0).alias("variant_no"), "text")
        made = expansion.expand(
            queries, self.config.rewrite, self.settings.rewrites if self.config.rewrite == "multi_query" else None, self.provider
        ).select("query_id", F.col("variant_no").cast("int").alias("variant_no"), "text")
        # each query is rewritten once
        return written(self._watch(made, "variants", calls=F.col("variant_no") == 0), "variants")

    def rankings(self, index: Index, texts: DataFrame, n: int) -> DataFrame:
        """hits(query_id, ranker_id, chunk_id, score, rank): dense rankings by variant, then lexical ones."""
        pair = F.struct("query_id", "variant_no")
        vectors = self._query_vectors(texts).select(F.to_json(pair).alias("query_id"), F.struct("query_id", "variant_no").alias("p"), "embedding")
        keys = vectors.select("query_id", "p")
        # vectors that are no table are made where they are searched
        held = index.chunks if index.docs is None else index.chunks.select("chunk_id", "ord", "text")
        found = dense.top_k(held, vectors.select("query_id", "embedding"), n, "chunk_id", "ord")
        out = found.join(keys, "query_id").select(
            F.col("p.query_id").alias("query_id"), F.col("p.variant_no").alias("ranker_id"), F.col("id").alias("chunk_id"), "score", "rank"
        )
        if self.config.hybrid:
            asked = texts.select(F.to_json(pair).alias("query_id"), F.struct("query_id", "variant_no").alias("p"), "text")
            words = lexical.top_k(index.lexical, asked.select("query_id", "text"), n, index.chunks.select("chunk_id", "ord"))
            out = out.unionByName(
                words.join(asked.select("query_id", "p"), "query_id").select(
                    F.col("p.query_id").alias("query_id"), (F.col("p.variant_no") + LEXICAL).alias("ranker_id"), "chunk_id", "score", "rank"
                )
            )
        return out

    def retrieve(self, index: Index, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """hits(query_id, chunk_id, doc_id, title, position, text, score, rank), rank being the place in the prompt."""
        texts = self.variants(queries)
        return self.select(index, queries, texts, written(self.rankings(index, texts, self._wide(top_k)), "rankings"), top_k)

    def _wide(self, top_k: int | None) -> int:
        """Length of the rankings that are fused."""
        return max(self.settings.candidates, top_k or self.settings.top_k)

    def select(self, index: Index, queries: DataFrame, texts: DataFrame, hits: DataFrame, top_k: int | None = None) -> DataFrame:
        """What ``retrieve`` gives, from the variants of the queries and their rankings."""
        k, n = top_k or self.settings.top_k, self._wide(top_k)
        single = not self.config.hybrid and not self.config.rewrite
        if single:
            fused = hits.filter(F.col("rank") <= n).select("query_id", "chunk_id", "score", "rank")
        elif self.config.fusion == "weighted":
            fused = self._weighted(hits, texts, n)
        else:
            fused = fusion.reciprocal_rank_fusion(hits, self.settings.rrf_k, n)
        shown = self._found(index, hits).select("chunk_id", "doc_id", "title", "position", "text")
        candidates = self._watch(with_chunks(fusion.deduplicate(fused), shown), "candidates")
        if self.config.relevance_filter:
            judged = rerank.relevance_filter(rerank.relevance_replies(candidates, queries, self.provider))
            judged = self._watch(judged, "relevant", kept=F.col("kept"), dropped=~F.col("kept"), calls=F.lit(1))
            candidates = judged.filter("kept").drop("kept")
        if self.config.rerank:
            final = rerank.rerank(candidates, queries, self.config.rerank, k, self.provider)
        else:
            final = candidates.filter(F.col("rank") <= k)
        if self.trace is not None:
            final = written(self._watch(final, "hits"), "hits")
        return ordering.reorder(final, self.config.order).select(
            "query_id", "chunk_id", "doc_id", "title", "position", "text", "score", "rank"
        )

    def _found(self, index: Index, hits: DataFrame) -> DataFrame:
        """Chunks that hold those of hits: where they are no table, only documents that were found are cut again."""
        if index.docs is None:
            return index.chunks
        named = hits.select(F.regexp_extract("chunk_id", "(?s)^(.*)#", 1).alias("found")).distinct()
        small = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
        own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))  # as in a chunk's id
        docs = index.docs.join(F.broadcast(named) if small else named, own == F.col("found"), "left_semi")
        return self.chunks(docs, index.strategy)

    def _weighted(self, hits: DataFrame, texts: DataFrame, n: int) -> DataFrame:
        """Weighted sum for queries with exactly two rankings, reciprocal ranks for the others."""
        sides = 2 if self.config.hybrid else 1
        counts = texts.groupBy("query_id").agg((F.count(F.lit(1)) * sides).alias("n"))
        two = hits.join(counts.filter("n = 2"), "query_id", "left_semi")
        rest = hits.join(counts.filter("n <> 2"), "query_id", "left_semi")
        place = F.when(F.col("ranker_id") == 0, 0).otherwise(1)
        split = two.withColumn("side", place)
        columns = ["query_id", "chunk_id", "score", "rank"]
        mixed = fusion.weighted_sum(
            split.filter("side = 0").select(*columns), split.filter("side = 1").select(*columns), self.settings.dense_weight, n
        )
        return mixed.unionByName(fusion.reciprocal_rank_fusion(rest, self.settings.rrf_k, n))

    def ask(self, index: Index, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, question, retrieve, context, n_hits, chunk_ids, answer, abstained, critique, final, model, techniques)."""
        decided = queries.withColumn("retrieve", F.lit(True))
        if self.config.retrieve_on_demand:
            asked = self._watch(reflect.retrieve_decisions(queries, self.provider), "decisions", retrieve=F.col("retrieve"), calls=F.lit(1))
            decided = written(asked, "decisions")
        wanted = decided.filter("retrieve").drop("retrieve")
        made = reflect.answers(wanted, self.retrieve(index, wanted, top_k), self.provider, self.settings.temperature, self.settings.max_tokens)
        made = self._watch(made, "answers", abstained=F.col("abstained"), calls=F.col("n_hits") > 0)
        if self.config.critique:
            made = reflect.critiques(made, self.provider)
            made = self._watch(made, "critiques", calls=F.col("critique").isNotNull())
        else:
            made = made.withColumn("final", F.col("answer"))
        made = made.withColumn("retrieve", F.lit(True)).withColumn("model", F.lit(self.model)).withColumn(
            "techniques", F.array(*[F.lit(x) for x in self.config.active()])
        )
        if not self.config.retrieve_on_demand:
            return made
        closed = reflect.closed_book_answers(decided.filter("not retrieve"), self.provider)
        closed = closed.withColumn("final", F.col("answer")).withColumn("retrieve", F.lit(False)).withColumn("n_hits", F.lit(0))
        return made.unionByName(closed, allowMissingColumns=True)

    def evaluate(self, index: Index, queries: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
        k = k or self.settings.top_k
        return metrics.evaluate(queries, self.retrieve(index, queries, k), qrels, k)

    def kept_index(self, docs: DataFrame, strategy: str = "recursive") -> Index:
        """The index with its chunks and vectors as a table: made once for all who read it."""
        chunks = written(self.embedded(self.chunks(docs, strategy)), "index_chunks")
        return Index(chunks, lexical.build_index(chunks.drop("embedding")), self.model)


def runs_of(index: Index, queries: DataFrame, configs: dict[str, Config], base: Pipeline) -> dict[str, DataFrame]:
    """The hits of several configurations over one index.

    Configurations that ask with the same texts and vectors share their rankings, which are
    written once: dense search, BM25 and model calls for rewrites and hypothetical documents are
    done once for them, and a configuration without BM25 leaves the lexical rankings out.
    """
    shared: dict[tuple, tuple[DataFrame, DataFrame]] = {}
    out = {}
    for name, config in configs.items():
        asks = config.hyde, config.rewrite
        if asks not in shared:
            hybrid = any(c.hybrid for c in configs.values() if (c.hyde, c.rewrite) == asks)
            asking = replace(base, config=replace(config, hybrid=hybrid))
            texts = asking.variants(queries)
            shared[asks] = texts, written(asking.rankings(index, texts, asking._wide(None)), "rankings")
        texts, hits = shared[asks]
        own = hits if config.hybrid else hits.filter(F.col("ranker_id") < LEXICAL)
        out[name] = replace(base, config=config).select(index, queries, texts, own)
    return out


def compare_chunking(docs: DataFrame, queries: DataFrame, qrels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a chunking strategy, dense retrieval only, all measured in one plan."""
    pipeline = Pipeline(settings, PRESETS["basic"])

    def hits(strategy: str) -> DataFrame:
        chunks = pipeline.embedded(pipeline.chunks(docs, strategy))
        # no lexical tables are needed, and no table of vectors: they are searched where they are made
        return pipeline.retrieve(Index(chunks, None, pipeline.model, docs, strategy), queries)

    runs = {s: hits(s) for s in ("fixed", "sentences", "recursive")}
    return metrics.comparison(metrics.by_config(queries, runs, qrels, settings.top_k))


STEPS = {
    "dense": Config(hybrid=False), "hybrid": Config(), "hybrid+hyde": Config(hyde=True), "hybrid+rerank": Config(rerank="pointwise"),
    "full": Config(hyde=True, rewrite="multi_query", rerank="pointwise", relevance_filter=True),
}
QUICK = ("dense", "hybrid")  # those without model calls


def ablation_by_query(docs: DataFrame, queries: DataFrame, qrels: DataFrame, settings: Settings = Settings(), quick: bool = False, provider=None) -> DataFrame:
    """(config, query_id, hit, rr, recall, precision, ndcg): cumulative configurations over one index."""
    base = Pipeline(settings, Config(), provider or LocalChat())
    configs = {n: c for n, c in STEPS.items() if n in QUICK or not quick}
    return metrics.by_config(queries, runs_of(base.kept_index(docs), queries, configs, base), qrels, settings.top_k)


def ablation(docs: DataFrame, queries: DataFrame, qrels: DataFrame, settings: Settings = Settings(), quick: bool = False, provider=None) -> DataFrame:
    """One row a cumulative configuration; ``quick`` keeps those without model calls."""
    return metrics.comparison(ablation_by_query(docs, queries, qrels, settings, quick, provider))
