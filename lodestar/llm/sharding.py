"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows get a global number 0..n-1 in the order of the key columns. A four-round
generalised Feistel network over Z_a x Z_b (a*b >= n, both near sqrt(n)) with
cycle walking maps numbers to positions one to one. A position p lies in shard
``p mod k`` at slot ``p div k``, so shard sizes differ by one row at most,
slots have no gaps, and anyone who knows (n, k, seed) can compute a row's place.

Cases: an empty table gives an empty result; null ids sort first; rows equal in
every key column are interchangeable; null text counts as empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, shuffle_width

PRIME = 2147483647  # 2^31 - 1: products of two residues fit a signed 64-bit integer
ROUNDS = 4
MAX_WALK = 64
ROW_BITS = 33  # monotonically_increasing_id(): partition above, row below


def round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], (seed * 48271 + 11) % PRIME
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            x = (x * 48271 + 12345) % PRIME
            pair.append(x | 1)
        keys.append((pair[0], pair[1]))
    return keys


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute_int(x: int, n: int, seed: int) -> int:
    """Position of row x, on the driver: what the Column form computes."""
    a, b = sides(n)
    keys = round_keys(seed)
    while True:
        left, right = x // b, x % b
        for i, (mul, add) in enumerate(keys):
            source = right if i % 2 == 0 else left
            y = (source * mul + add) % PRIME
            y = (y * y + source) % PRIME
            if i % 2 == 0:
                left = (left + y) % a
            else:
                right = (right + y) % b
        x = left * b + right
        if x < n:
            return x


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    keys = F.array(
        *[
            F.struct(F.lit(mul).alias("mul"), F.lit(add).alias("add"), F.lit(i % 2 == 0).alias("even"))
            for i, (mul, add) in enumerate(round_keys(seed))
        ]
    )

    def noise(source: Column, key: Column) -> Column:
        y = (source * key["mul"].cast("long") + key["add"].cast("long")) % F.lit(PRIME)
        return (y * y + source) % F.lit(PRIME)

    def step(state: Column, key: Column) -> Column:
        left, right = state["l"], state["r"]
        return F.when(
            key["even"],
            F.struct(((left + noise(right, key)) % F.lit(a)).alias("l"), right.alias("r")),
        ).otherwise(F.struct(left.alias("l"), ((right + noise(left, key)) % F.lit(b)).alias("r")))

    start = F.struct(
        F.call_function("div", x, F.lit(b)).cast("long").alias("l"),
        (x % F.lit(b)).cast("long").alias("r"),
    )
    return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(x: Column, n: int, seed: int) -> Column:
    """Position of row number x among n.

    At most a + b - 1 points of the domain lie outside 0..n-1, so a walk of
    MAX_WALK steps always ends for n <= 900; beyond, the chance that a walk is
    longer is under (2/sqrt(n))^MAX_WALK, below 1e-75.
    """
    a, b = sides(n)
    if a * b == n:
        return _network(x, a, b, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        _network(x, a, b, seed),
        lambda at, _: F.when(at < F.lit(n), at).otherwise(_network(at, a, b, seed)),
    )
    return walked


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """df with ``row_no``, its global number in the given order, and the row count.

    One range shuffle, cut to the shared folder; the per-partition counts (one
    row a partition) give the offsets. The last sort key is the row's place in
    the scan, so equal keys spread over partitions.
    """
    spark = df.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "row_no"]).alias("row")
    keyed = df.select(kept, *[c.alias(f"__k{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("__scan"))
    by = [F.col(f"__k{i}").asc_nulls_first() for i in range(len(order))] + [F.col("__scan").asc()]
    placed = (
        keyed.repartitionByRange(shuffle_width(spark), *by)
        .sortWithinPartitions(*by)
        .select("row", F.monotonically_increasing_id().alias("__at"))
        .select(
            "row",
            F.shiftright("__at", ROW_BITS).cast("int").alias("__part"),
            F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("__row"),
        )
    )
    placed = scratch.cut(placed, name)
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "__part int, __start long")
    # one row a shuffle partition: the broadcast is bounded by that setting
    out = placed.join(F.broadcast(offsets), "__part").select("row.*", (F.col("__row") + F.col("__start")).alias("row_no"))
    return out, total


def shard_rows(
    df: DataFrame, order: list[Column], n_shards: int, seed: int, scratch: Scratch, name: str = "numbered"
) -> DataFrame:
    """df with ``row_no``, ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows, n = numbered(df, order, scratch, name)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    placed = rows.select(F.struct(*kept).alias("row"), permuted(F.col("row_no"), max(1, n), seed).alias("at"))
    return placed.select(
        "row.*",
        (F.col("at") % F.lit(n_shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("at"), F.lit(n_shards)).cast("long").alias("slot"),
    )
