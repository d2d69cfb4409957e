"""URL filters over a sorted digest array.

A list of keys (``host/path-prefix``) becomes shards: files in the folder that all executors
share, each with the sorted 64-bit xxhash digests of its keys, where each key's text starts,
the texts, and a verdict byte. Tasks map the files into memory, so only the parts that a
probe touches are read, and the processes of a machine share them. A batch of probes is
looked up by vectorised binary search; every digest found is confirmed against the stored
text, so two strings of one digest are never taken for each other. Pages are judged where
they are scanned: no shuffle, no broadcast, no hot host.

A shard holds about SHARD_KEYS keys; a key's shard is the top bits of its digest. The driver
holds one number a shard and the shapes of the keys (how many host labels, how long a path;
no texts). ``spark.checkpoint.dir`` must be a mounted folder, as only files can be mapped.

Cases: null urls and urls without ``://`` have empty host and path and fit no key; a key
listed twice counts once, ``block`` before ``allow``; null keys and keys without a host or
``/`` are left out; an empty list lists nothing; repeated pages are judged each; columns named
``host``, ``path``, ``rule`` or ``verdict`` give way to those made here, all others stay.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, by_value, shared_dir

by_value(__name__)

SHARD_KEYS = 1 << 20
MAX_SHARD_BITS = 16
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = {"digests": "<i8", "starts": "<i8", "texts": "u1", "blocked": "u1"}
MADE = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(key: Column) -> Column:
    return F.xxhash64(key)


def mounted(uri: str) -> str:
    """The folder's path on every machine."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"a URL list is mapped into memory and needs a mounted folder, not {uri}")
    return unquote(parsed.path)


class ShardFiles:
    """The files of one shard being written. They take their names when they are whole, so
    attempts of a task that run twice or die leave nothing half-made under a shard's name."""

    def __init__(self, folder: str, shard: int):
        os.makedirs(folder, exist_ok=True)
        self.shard, self.n, self.start, token = shard, 0, 0, uuid.uuid4().hex
        self.names = {part: f"{folder}/{shard:05d}.{part}" for part in PARTS}
        self.files = {part: open(f"{name}.{token}", "wb") for part, name in self.names.items()}  # noqa: SIM115

    def write(self, digests: np.ndarray, texts: list[bytes], blocked: np.ndarray) -> None:
        starts = self.start + np.cumsum([0, *map(len, texts)])
        self.start, self.n = int(starts[-1]), self.n + len(texts)
        for part, values in (("digests", digests), ("starts", starts[:-1]), ("blocked", blocked)):
            self.files[part].write(np.asarray(values).astype(PARTS[part]).tobytes())
        self.files["texts"].write(b"".join(texts))

    def close(self) -> dict[str, int]:
        self.files["starts"].write(np.array([self.start], "<i8").tobytes())
        for part, file in self.files.items():
            file.close()
            os.replace(file.name, self.names[part])
        return {"shard": self.shard, "n": self.n}


def shard_writer(folder: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: ShardFiles | None = None
        done = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if open_files is None or open_files.shard != int(shards[a]):
                    if open_files is not None:
                        done.append(open_files.close())
                    open_files = ShardFiles(folder, int(shards[a]))
                own = batch.slice(a, b - a)
                texts = [x.encode() for x in own.column("key").to_pylist()]
                open_files.write(own.column("digest").to_numpy(), texts, own.column("blocked").to_numpy(zero_copy_only=False))
        if open_files is not None:
            done.append(open_files.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())]))

    return written


class Maps:
    """Shards mapped into memory when first probed."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]):
        self.folder, self.bits, self.sizes, self.open = folder, bits, sizes, {}

    def shard(self, number: int) -> dict[str, np.ndarray]:
        if number not in self.open:
            self.open[number] = {p: np.memmap(f"{self.folder}/{number:05d}.{p}", dtype=t, mode="r") for p, t in PARTS.items()}
        return self.open[number]

    def lookup(self, digests: np.ndarray, texts: pa.Array) -> np.ndarray:
        """For each probe -1 if its text is not listed, 0 if it is allowed, 1 if blocked."""
        found = np.full(len(digests), -1, np.int8)
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        asked = memoryview(texts.buffers()[2] or b"")
        numbers = (digests >> (64 - self.bits)) + (1 << self.bits >> 1) if self.bits else np.zeros(len(digests), np.int64)
        for number in np.unique(numbers):
            if int(number) not in self.sizes:
                continue
            own, at = self.shard(int(number)), np.flatnonzero(numbers == number)
            low = np.searchsorted(own["digests"], digests[at], "left")
            high = np.searchsorted(own["digests"], digests[at], "right")
            stored, starts, blocked = memoryview(own["texts"]), own["starts"], own["blocked"]
            for i in np.flatnonzero(low < high):
                probe = asked[offsets[at[i]] : offsets[at[i] + 1]]
                for j in range(low[i], high[i]):  # more than one only if digests collide
                    if stored[starts[j] : starts[j + 1]] == probe:
                        found[at[i]] = blocked[j]
                        break
        return found


@dataclass
class UrlList:
    """A built list. ``shapes`` are the (host labels, path length) that its keys have."""

    folder: str
    bits: int = 0
    sizes: dict[int, int] = field(default_factory=dict)
    shapes: list[tuple[int, int]] = field(default_factory=list)

    def candidates(self, host: Column, path: Column) -> Column:
        """Every string that could be a key for the url: so many last labels of the host and
        as long a prefix of the path as some key has."""
        shapes = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length")) for k, n in self.shapes])
        labels, long = F.split(host, r"\."), F.length(path)
        fitting = F.filter(shapes, lambda s: (s["labels"] <= F.size(labels)) & (s["length"] <= long))
        return F.transform(
            fitting,
            lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), "."), F.substring(path, F.lit(1), s["length"])),
        )

    def probe(self, candidates: Column) -> Column:
        """For each candidate -1 (not listed), 0 (allowed) or 1 (blocked)."""
        folder, bits, sizes = self.folder, self.bits, self.sizes

        @F.arrow_udf("array<tinyint>")
        def looked_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            maps = Maps(folder, bits, sizes)
            for texts, digests in batches:
                found = maps.lookup(digests.flatten().to_numpy(), texts.flatten())
                counts = np.diff(texts.offsets.to_numpy())
                yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(found))

        return looked_up(candidates, F.transform(candidates, digest))


def build_list(entries: DataFrame, scratch: Scratch, shard_keys: int = SHARD_KEYS) -> UrlList:
    """A list of ``entries`` (key string, verdict string), written to the shared folder."""
    spark = entries.sparkSession
    host = F.translate(F.substring_index("key", "/", 1), UPPER, LOWER)
    valid = entries.filter(F.instr("key", "/") > 1).select(host.alias("host"), F.expr("substring(key, instr(key, '/'))").alias("path"), (F.col("verdict") == BLOCK).alias("blocked"))
    name = f"url_keys-{uuid.uuid4().hex[:8]}"
    keys = scratch.cut(valid.groupBy("host", "path").agg(F.max("blocked").cast("tinyint").alias("blocked")), name)
    n = keys.count()
    uri = f"{shared_dir(spark)}/lodestar/url_list-{uuid.uuid4().hex}"
    made = UrlList(mounted(uri), min(MAX_SHARD_BITS, max(0, (-(-n // shard_keys) - 1).bit_length())))
    scratch.paths[uri] = uri
    shapes = keys.groupBy(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).count()
    made.shapes = sorted((r["k"], r["n"]) for r in shapes.select("k", "n").collect())
    key = F.concat("host", "path")
    shard = F.shiftright("digest", 64 - made.bits) + (1 << made.bits >> 1) if made.bits else F.lit(0)
    rows = keys.select(key.alias("key"), digest(key).alias("digest"), "blocked").withColumn("shard", shard.cast("int"))
    dealt = rows.repartition(1 << made.bits, "shard").sortWithinPartitions("shard", "digest", "key")
    made.sizes = {r["shard"]: r["n"] for r in dealt.mapInArrow(shard_writer(made.folder), "shard int, n long").collect()}
    scratch.drop(name)
    return made


def judge_urls(pages: DataFrame, url: str, rules: UrlList, listed: UrlList | None = None) -> DataFrame:
    """pages with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting key of ``rules`` decides (of equally long ones that with the longer
    host). Where none fits, a url is blocked if a blocking key of ``listed`` fits and allowed
    otherwise; there an empty path counts as ``/``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in MADE])
    held = pages.select(row.alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    held = held.withColumn("c", rules.candidates(F.col("host"), F.col("path")) if rules.shapes else F.array().cast("array<string>"))
    if listed is not None and listed.shapes:
        held = held.withColumn("l", listed.candidates(F.col("host"), F.when(F.col("path") == "", "/").otherwise(F.col("path"))))
        held = held.withColumn("black", F.array_contains(listed.probe(F.col("l")), F.lit(1).cast("tinyint")))
    else:
        held = held.withColumn("black", F.lit(False))
    fits = F.filter(
        F.zip_with("c", rules.probe(F.col("c")), lambda c, v: F.struct(F.length(c).alias("n"), F.instr(c, "/").alias("at"), c.alias("key"), v.alias("v"))),
        lambda s: s["v"] >= 0,
    )
    held = held.withColumn("best", F.array_max(fits))
    verdict = F.when(F.coalesce(F.col("best.v") == 1, F.col("black")), BLOCK).otherwise(ALLOW)
    return held.select("row.*", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def mostly_blocked(judged: DataFrame) -> DataFrame:
    """Entries (key, verdict) that block the hosts of whose pages rules block more than half
    of those they decide."""
    told = judged.filter("rule is not null").groupBy("host").agg(F.avg((F.col("verdict") == BLOCK).cast("int")).alias("share"))
    return told.filter("share > 0.5").select(F.concat("host", F.lit("/")).alias("key"), F.lit(BLOCK).alias("verdict"))
