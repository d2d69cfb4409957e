"""Embedding whitening: one pass of Welford updates, merged as a tree, then symmetric QR.

Every task streams its vectors into a count, a mean and the sum of outer products of
deviations by Welford's rank-one update; sums of the integer vectors are kept beside them,
exactly. A task gives out one row of d^2 numbers. These rows are merged by the parallel update
formula, FAN at a time and round after round, so the driver gets one row whatever the number
of tasks. It solves the d x d covariance by Householder tridiagonalisation and implicitly
shifted QR. Whitening is a product per Arrow batch with d x k numbers, which tasks carry along.
A second pass measures the covariance of the whitened vectors in the same way.

Cases: null vectors, vectors with null or non-finite entries or entries of magnitude 2^20 or
more, empty vectors, and vectors that have not the most frequent length (the longer of equally
frequent ones) are left out; an empty table gives no rows. Directions without variance are not
returned, so equal vectors or fewer vectors than dimensions give fewer components. Repeated
ids and vectors count each. ``deviation`` is null where it does not fit 64 bits. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, by_value

by_value(__name__)

SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 20)
COMPONENTS = 8
FAN = 16
MOMENTS = "slot int, n long, sums array<long>, mean array<double>, scatter array<double>"
#: eigenvalues below this share of the largest are rounding errors of zero
NO_VARIANCE = 1e-11


@dataclass
class Moments:
    """n vectors, their exact integer sums (zeros where the vectors are not integers), their
    mean, and the sum of outer products of deviations from it."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))

    def update(self, vectors: np.ndarray) -> None:
        """Welford: one rank-one update a vector."""
        product = np.empty_like(self.scatter)
        for x in vectors:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply.outer(before, x - self.mean, out=product)
            self.scatter += product
        if vectors.dtype.kind == "i":
            self.sums += vectors.sum(axis=0)

    def merge(self, other: Moments) -> None:
        """The parallel update: as if the other's vectors had been streamed in too."""
        n = self.n + other.n
        if not other.n:
            return
        apart = other.mean - self.mean
        self.scatter += other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.sums, self.n = self.sums + other.sums, n

    def batch(self, slot: int) -> pa.RecordBatch:
        lists = [pa.array([x.ravel()]) for x in (self.sums, self.mean, self.scatter)]
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([self.n]), *lists], names=["slot", "n", "sums", "mean", "scatter"])

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


def rows_of(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(-1, d)


def streamed(d: int):
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.none(d)
        for batch in batches:
            own.update(rows_of(batch.column(0), d))
        if own.n:
            yield own.batch(TaskContext.get().partitionId())

    return one


def merged(d: int):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, own = None, Moments.none(d)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if slot != row["slot"].as_py():
                    if slot is not None:
                        yield own.batch(slot)
                    slot, own = row["slot"].as_py(), Moments.none(d)
                lists = [row[c].values.to_numpy() for c in ("sums", "mean", "scatter")]
                own.merge(Moments(row["n"].as_py(), lists[0], lists[1].copy(), lists[2].reshape(d, d).copy()))
        if slot is not None:
            yield own.batch(slot)

    return groups


def moments(vectors: DataFrame, d: int, scratch: Scratch, name: str = "moments") -> Moments:
    """Moments of a frame of one column: arrays of d numbers, no nulls."""
    rows = scratch.cut(vectors.mapInArrow(streamed(d), MOMENTS), name)
    last, slots = name, (rows.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        slots = -(-slots // FAN)
        dealt = rows.withColumn("place", F.col("slot")).withColumn("slot", F.floor(F.col("slot") / FAN).cast("int"))
        dealt = dealt.repartition(slots, "slot").sortWithinPartitions("slot", "place").drop("place")
        rows = scratch.cut(dealt.mapInArrow(merged(d), MOMENTS), f"{name}_{slots}")
        scratch.drop(last)
        last = f"{name}_{slots}"
        if slots == 1:
            break
    row = rows.first()
    scratch.drop(last)
    if row is None:
        return Moments.none(d)
    return Moments(row["n"], np.array(row["sums"], np.int64), np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the orthogonal q of a symmetric matrix (Householder)."""
    a, n = matrix.copy(), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v /= length
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    d, e, q = tridiagonal(np.asarray(matrix, float))
    tiny = np.finfo(float).eps
    high = len(d) - 1
    while high > 0:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if e[high - 1] == 0:
            high -= 1
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        low = zeros[-1] + 1 if len(zeros) else 0
        # Wilkinson's shift: the eigenvalue of the last 2 x 2 block that is nearer to its corner
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            a, b, side = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * side + s * s * b, s * s * a - 2 * c * s * side + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * side
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[:, [k, k + 1]] = q[:, [k, k + 1]] @ np.array([[c, -s], [s, c]])
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def whitener(fit: Moments, values: np.ndarray, vectors: np.ndarray):
    """A column of (deviation, whitened) of integer vectors."""
    n, sums, weights = fit.n, fit.sums, vectors / np.sqrt(values)

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def whitened(lists: pa.Array) -> pa.Array:
        apart = n * rows_of(lists, len(sums)) - sums
        exact = (apart * apart).sum(axis=1)
        fits = (apart.astype(float) ** 2).sum(axis=1) < 2.0**63 * 0.999
        flat = ((apart / n) @ weights).ravel()
        cuts = pa.array(np.arange(0, len(flat) + 1, weights.shape[1], dtype=np.int32))
        return pa.StructArray.from_arrays([pa.array(exact, mask=~fits), pa.ListArray.from_arrays(cuts, pa.array(flat))], names=["deviation", "whitened"])

    return whitened


def whiten(df: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error, eigenvalue).

    Vectors are taken to the integers floor(SCALE * c) + OFFSET first; see the module's text.
    """
    vec = F.col(f"`{vector}`")
    usable = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(LARGEST), F.lit(False)))
    kept = df.filter(usable & (F.size(vec) > 0)).select(F.col(f"`{id_column}`"), vec.alias("vector"))
    common = kept.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    names = f"{id_column} {dict(df.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    if common is None:
        return df.sparkSession.createDataFrame([], names)
    d = common["d"]
    # the offset moves no deviation: without it the doubles of the fit keep more digits
    near = F.transform("vector", lambda c: F.floor(SCALE * c.cast("double")).cast("long"))
    kept = kept.filter(F.size("vector") == d).select(F.col(f"`{id_column}`"), near.alias("near"))
    fit = moments(kept.select("near"), d, scratch)
    covariance = fit.covariance()
    values, vectors = symmetric_qr(covariance)
    live = int((values[:components] > NO_VARIANCE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not live:
        return df.sparkSession.createDataFrame([], names)
    column = whitener(fit, values[:live], vectors[:, :live])
    white = kept.select(F.col(f"`{id_column}`"), column("near").alias("w"))
    again = moments(white.select("w.whitened"), live, scratch, "whitened")
    error = float(np.abs(again.covariance() - np.eye(live)).max())
    told = F.array(*[F.struct(F.lit(float(v / np.trace(covariance))).alias("explained"), F.lit(float(v)).alias("eigenvalue")) for v in values[:live]])
    out = white.select(F.col(f"`{id_column}`"), "w.deviation", F.posexplode("w.whitened").alias("at", "whitened"))
    return out.select(
        F.col(f"`{id_column}`"), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        told[F.col("at")]["explained"].alias("explained"), F.lit(error).alias("identity_error"), told[F.col("at")]["eigenvalue"].alias("eigenvalue"),
    )
