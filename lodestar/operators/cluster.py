"""Cosine k-means over any number of rows and clusters.

Up to FAN clusters are centres in the plan: k-means|| draws them in a fixed number of passes,
and a Lloyd round is one scan in which every task adds up its rows by nearest centre. What is
shipped and gathered is FAN centres at most.

More clusters are made in cells. A cell with more than LEAF rows is split by centres fitted
to a sample of SAMPLE of its rows, all cells of a level in the same pass; rows meet their
cell's centres in a shuffle whose keys are salted by the cell's size. Each cell of at most LEAF
rows is then clustered in one task, with its share of the clusters. No centres are broadcast or
gathered, and the number of passes grows with the logarithm of the rows. There a row is held
against the centres of its own cell only.

Cases: an empty table gives no rows; k is held to 1..n; a null vector counts as zeros, a shorter
one as ended by zeros; vectors without length lie at distance 1 from all; ties go to the lowest
label; rows that cannot be told apart by direction are split by hash; ids may be of any type and
repeat.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.dense import cosine, numbered
from lodestar.session import Scratch, written

MAX_ITERATIONS, SEED = 30, 42
FAN = 256
ROUNDS, OVERSAMPLING = 5, 2  # passes of k-means||, and rows drawn in each as a multiple of k
LEAF, SAMPLE = 4096, 4096
SPLIT_ROWS = 100_000  # rows of a cell that one task holds against its centres
ROW = ("h", "h2", "n", "embedding")  # a vector, told by two hashes, and how many rows have it
DEPTH = 6  # levels after which a cell is split by hash
DIGITS = 12  # distances are compared after rounding, so ties fall alike everywhere


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1.0 when a vector has no length."""
    return F.lit(1.0) - cosine(a, b)


def matrix_of(lists: pa.Array, d: int) -> np.ndarray:
    if lists.null_count == 0 and len(lists.flatten()) == len(lists) * d and (np.diff(lists.offsets.to_numpy()) == d).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    out = np.zeros((len(lists), d))
    for i, x in enumerate(lists.to_pylist()):
        own = np.array([v or 0.0 for v in (x or [])[:d]])
        out[i, : len(own)] = own
    return out


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None, :]
    return np.round(1.0 - np.divide(rows @ centres.T, size, out=np.zeros(size.shape), where=size > 0), DIGITS) + 0.0


def nearest(centres: np.ndarray) -> Column:
    """Column (label, d) of ``embedding``: its nearest centre, ties to the lowest label."""

    @F.arrow_udf("struct<label: int, d: double>")
    def found(lists: pa.Array) -> pa.Array:
        apart = distances(matrix_of(lists, centres.shape[1]), centres)
        label = apart.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(label.astype(np.int32)), pa.array(apart[np.arange(len(label)), label])], names=["label", "d"])

    return found("embedding")


def assign(vectors: DataFrame, centres: DataFrame, block: int = 8 * FAN) -> DataFrame:
    """(id, embedding, label): nearest centre of ``centres`` (label, centre) by cosine distance,
    ties to the lowest label. Centres are shipped in blocks of bounded size, a scan a block."""
    n = max(1, -(-centres.count() // block))
    best = None
    for i in range(n):
        part = centres if n == 1 else centres.filter(F.pmod(F.xxhash64("label"), F.lit(n)) == i)
        rows = part.orderBy("label").collect()
        if not rows:
            continue
        labels = F.array(*[F.lit(r["label"]) for r in rows]) if [r["label"] for r in rows] != list(range(len(rows))) else None
        own = nearest(np.array([r["centre"] for r in rows]))
        scored = (best if best is not None else vectors).withColumn("own", own)
        told = F.struct(F.col("own.d").alias("d"), (F.col("own.label") if labels is None else labels[F.col("own.label")]).alias("label"))
        scored = scored.withColumn("best", told if best is None else F.least("best", told)).drop("own")
        best = scored if i == n - 1 else written(scored, "nearest")
    return best.withColumn("label", F.col("best.label")).drop("best")


def seed_centres(rows: np.ndarray, k: int, seed: int = SEED, counts: np.ndarray | None = None) -> np.ndarray:
    """First centre at random, each further one with a chance by its squared distance times
    the rows it stands for. The order of the draws is fixed, so equal rows give equal labels."""
    draw = random.Random(seed)
    held = np.ones(len(rows)) if counts is None else counts
    chosen = [rows[draw.randrange(len(rows))]]
    near = np.full(len(rows), np.inf)
    while len(chosen) < k:
        near = np.minimum(near, distances(rows, chosen[-1][None, :])[:, 0])
        weight = near**2 * held
        total = float(weight.sum())
        if total == 0:
            chosen.append(rows[draw.randrange(len(rows))])
            continue
        goal = draw.random() * total
        chosen.append(rows[min(len(rows) - 1, int(np.searchsorted(np.cumsum(weight), goal)))])
    return np.stack(chosen)


def lloyd(rows: np.ndarray, k: int, rounds: int, seed: int = SEED, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of rows that one task holds, each standing for ``counts`` equal
    rows. An empty cluster keeps its centre."""
    held = np.ones(len(rows)) if counts is None else counts
    centres, labels = seed_centres(rows, k, seed, held), None
    for _ in range(rounds):
        fresh = distances(rows, centres).argmin(axis=1)
        if labels is not None and (fresh == labels).all():
            break
        labels = fresh
        order = np.argsort(labels, kind="stable")
        used, starts = np.unique(labels[order], return_index=True)
        centres[used] = np.add.reduceat((rows * held[:, None])[order], starts) / np.add.reduceat(held[order], starts)[:, None]
    return labels, centres


def _uniform(round_no: int, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64("h", F.lit(round_no), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def seeds(rows: DataFrame, k: int, d: int, seed: int = SEED) -> np.ndarray:
    """k-means|| over rows(h, embedding): one row at random, then ROUNDS passes that each draw
    OVERSAMPLING * k rows by squared distance from those drawn before; the drawn rows, each
    counted with the rows it is nearest to, are reduced to k by weighted D^2 draws."""
    drawn: dict[int, np.ndarray] = {}

    def draw(order: Column, some: DataFrame, n: int) -> None:
        for r in some.select("h", "embedding", order.alias("o")).orderBy("o", "h").limit(n).collect():
            drawn[r["h"]] = matrix_of(pa.array([r["embedding"]], pa.list_(pa.float64())), d)[0]

    draw(_uniform(0, seed), rows, 1)
    for i in range(1, ROUNDS + 1):
        before = len(drawn)
        weighed = rows.withColumn("w", F.pow(nearest(np.stack(list(drawn.values())))["d"], 2)).filter("w > 0")
        draw(-F.log(_uniform(i, seed)) / F.col("w"), weighed, OVERSAMPLING * k)
        if len(drawn) == before:
            break
    if len(drawn) < k:  # fewer directions than clusters: any rows do
        draw(_uniform(-1, seed), rows, k + len(drawn))
    candidates = np.stack(list(drawn.values()))
    counts = np.zeros(len(candidates))
    for r in rows.select(nearest(candidates)["label"].alias("label")).groupBy("label").count().collect():
        counts[r["label"]] = r["count"]
    return seed_centres(candidates, k, seed, counts)


SUMS = "label int, part int, n long, total array<double>, mark long"


def _summed(centres: np.ndarray):
    k, d = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, mark = np.zeros(k, np.int64), np.zeros((k, d)), np.zeros(k, np.int64)
        for batch in batches:
            rows = matrix_of(batch.column("embedding"), d)
            label = distances(rows, centres).argmin(axis=1)
            np.add.at(n, label, 1)
            np.add.at(total, label, rows)
            np.add.at(mark, label, batch.column("h").to_numpy())
        used = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * d + 1, d, dtype=np.int32)), pa.array(total[used].ravel()))
        part = np.full(len(used), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(part), pa.array(n[used]), lists, pa.array(mark[used])], names=["label", "part", "n", "total", "mark"])

    return sums


def _added(d: int):
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # FAN labels at most
        for batch in batches:
            total = matrix_of(batch.column("total"), d)
            for i, (label, n, mark) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "n", "mark")), strict=True)):
                own = held.setdefault(label, [0, np.zeros(d), np.zeros(1, np.int64)])
                own[0] += n
                own[1] += total[i]
                own[2] += np.int64(mark)
        rows = [{"label": k, "part": 0, "n": v[0], "total": v[1].tolist(), "mark": int(v[2][0])} for k, v in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("label", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("mark", pa.int64())]))

    return added


def settle(rows: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """Centres that rows(h, embedding) settle on: a scan a round, sums by task, FAN rows to
    the driver. Ends when no row changes its label; the last labels are by the centres before."""
    last = None
    for _ in range(rounds):
        parts = rows.mapInArrow(_summed(centres), SUMS).repartition(min(8, len(centres)), "label").sortWithinPartitions("label", "part")
        found = parts.mapInArrow(_added(centres.shape[1]), SUMS).collect()
        marks = sorted((r["label"], r["n"], r["mark"]) for r in found)
        if marks == last:
            break
        last, before, centres = marks, centres, centres.copy()
        for r in found:
            centres[r["label"]] = np.array(r["total"]) / r["n"]
    return before


def _fitted(d: int):
    """Centres of a cell's sample, none if its rows have one direction."""

    def fit(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        rows = matrix_of(batches.column("embedding").combine_chunks(), d)
        fan = batches.column("fan")[0].as_py()
        apart = distances(rows, rows[:1]).max() > 0
        centres = lloyd(rows, min(fan, len(rows)), 5)[1] if apart else np.zeros((0, d))
        return pa.table({"cell": [key[0].as_py()], "fan": pa.array([fan], pa.int32()), "salts": pa.array([batches.column("salts")[0].as_py()], pa.int32()), "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64()))})

    return fit


def _moved(d: int, level: int):
    """Rows (cell, salt, kind 1) behind their cell's centres (kind 0): the cell below."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fan, centres = None, 0, None
        for batch in batches:
            kinds, cells = batch.column("kind").to_numpy(), batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (cells[1:] != cells[:-1]) | (kinds[1:] == 0)))).tolist() + [len(kinds)] if len(kinds) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                if kinds[a] == 0:
                    cell, fan = int(cells[a]), own.column("fan")[0].as_py()
                    centres = own.column("embedding")[0].values.to_numpy().reshape(-1, d)
                    continue
                h = own.column("h").to_numpy()
                if int(cells[a]) != cell:
                    below = cells[a:b]
                elif len(centres) and level < DEPTH:
                    below = cell * (FAN + 1) + 1 + distances(matrix_of(own.column("embedding"), d), centres).argmin(axis=1)
                else:
                    below = cell * (FAN + 1) + 1 + ((h >> (8 * level % 56)) & 0xFFFF) % fan
                yield pa.RecordBatch.from_arrays([own.column("h"), own.column("h2"), own.column("n"), own.column("embedding"), pa.array(below.astype(np.int64))], names=[*ROW, "cell"])

    return moved


def cells(rows: DataFrame, d: int, scratch: Scratch) -> DataFrame:
    """rows(h, h2, n, embedding) with ``cell``, of which none holds more than LEAF rows."""
    schema = "h long, h2 long, n long, embedding array<double>, cell long"
    table, name, done = rows.withColumn("cell", F.lit(0).cast("long")), None, None
    for level in range(DEPTH + 4):
        size = F.col("size")
        sizes = table.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(size > LEAF).select(
            "cell", "size", F.least(F.lit(FAN), F.ceil(2 * size / LEAF)).cast("int").alias("fan"), F.ceil(size / SPLIT_ROWS).cast("int").alias("salts")
        )
        sizes = scratch.cut(sizes, f"sizes{level}")
        if not sizes.limit(1).count():
            break
        large = table.join(sizes, "cell", "left")
        chance = (F.shiftrightunsigned(F.xxhash64("h", F.lit(level)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        sample = large.filter(size.isNotNull() & (chance <= F.lit(float(SAMPLE)) / size)).select("cell", "fan", "salts", "embedding")
        splits = scratch.cut(sample.groupBy("cell").applyInArrow(_fitted(d), "cell long, fan int, salts int, centres array<double>"), f"splits{level}")
        ahead = splits.select(*[F.lit(0).cast("long").alias(c) for c in ROW[:3]], F.col("centres").alias("embedding"), "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "fan")
        behind = large.filter(size.isNotNull()).select(*ROW, "cell", F.pmod(F.xxhash64("h"), F.col("salts").cast("long")).cast("int").alias("salt"), F.lit(1).alias("kind"), "fan")
        both = ahead.unionByName(behind).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
        split = both.mapInArrow(_moved(d, level), schema)
        small = scratch.cut(large.filter(size.isNull()).select(*ROW, "cell"), "small")
        done = small if done is None else done.unionByName(small)
        table, last, name = scratch.cut(split, f"level{level}"), name, f"level{level}"
        if last:
            scratch.drop(last)
        scratch.drop(f"sizes{level}", f"splits{level}")
    return table if done is None else table.unionByName(done)


def _leaves(d: int, share: float, rounds: int):
    def leaf(key: tuple[pa.Scalar, ...], batches: pa.Table) -> pa.Table:
        order = np.argsort(batches.column("h").to_numpy(), kind="stable")
        rows = matrix_of(batches.column("embedding").combine_chunks(), d)[order]
        k = min(len(rows), max(1, round(share * len(rows))))
        labels = lloyd(rows, k, rounds, counts=batches.column("n").to_numpy()[order].astype(float))[0]
        keys = [batches.column(c).take(pa.array(order)) for c in ROW[:2]]
        return pa.table({"h": keys[0], "h2": keys[1], "cell": pa.array(np.full(len(rows), key[0].as_py())), "own": pa.array(labels.astype(np.int32))})

    return leaf


def kmeans(vectors: DataFrame, k: int, max_iterations: int = MAX_ITERATIONS, seed: int = SEED, start: list[list[float]] | None = None) -> DataFrame:
    """(id, label) of vectors(id, embedding), labels from 0.

    With up to FAN clusters every row is held against every centre and there are k centres
    (labels that no row takes are missing). With more, see the module's text: each cell has
    its share of k, rounded, one at least, and labels have no gaps. ``start`` gives the first
    centres, k = FAN of them at most, in place of drawn ones.
    """
    scratch = Scratch(vectors.sparkSession)
    base = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    base = scratch.cut(base.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.col("embedding"))), "vectors")
    n, d = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    k = max(1, min(k, n)) if start is None else len(start)
    if k > FAN and start is not None:
        raise ValueError(f"at most {FAN} centres can be given")
    if n == 0 or k == 1 or d < 1:
        labelled = base.select("id", F.lit(0).alias("label"))
    elif k <= FAN:
        centres = settle(base, seeds(base, k, d, seed) if start is None else np.array(start, float), max_iterations)
        labelled = base.select("id", nearest(centres)["label"].alias("label"))
    else:
        # equal vectors are one row with a count: they share a label, however many they are
        hashes = base.select("id", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(seed), F.col("embedding")).alias("h2"))
        once = scratch.cut(hashes.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")).select(*ROW), "once")
        share = k / once.count()
        leaves = cells(once, d, scratch).groupBy("cell").applyInArrow(_leaves(d, share, max_iterations), "h long, h2 long, cell long, own int")
        leaves = scratch.cut(leaves, "leaves")
        places = numbered(leaves.select(F.struct("cell", "own").alias("id"))).select(F.col("id").alias("place"), F.col("at").cast("int").alias("label"))
        told = scratch.cut(leaves.join(places, F.struct("cell", "own") == F.col("place")).select("h", "h2", "label"), "told")
        labelled = hashes.drop("embedding").join(told, ["h", "h2"]).select("id", "label")
    labelled = written(labelled, "labels")
    scratch.close()
    return labelled
