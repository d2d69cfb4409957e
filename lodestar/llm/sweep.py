"""Peak concurrency: how many intervals are open, by group and moment.

A set of intervals is a *step function*: sorted moments and what each adds to the count and
to the sum of money that are open. Every task builds the function of whatever rows it has
and gives it out in pieces, cut by (group, range of time). Functions are added, so the pieces
of a range are merged pairwise, FAN of them in a task and round, round after round until one
is left. A carry scan over the ranges' totals then tells each piece where it starts, and the
pieces are unrolled into rows.

Bounds: a piece has RANGE_SECONDS moments at most, however many rows fall into its range, and
a task holds BUFFER moments before it gives its function out. The carry scan sees one row a
range, in two levels of at most 2^SUPER_BITS rows (Spark's timestamps span 2^26 ranges).
Nothing is broadcast or collected but the number of tasks that made pieces.

Cases: null starts and ends not after their start take no part; a null end is open for ever;
null money counts as 0, so do NaN and infinity. A client that ``clients`` does not know, a
null client and a null nation give ``UNKNOWN``; of several rows for a client the least nation
counts. Repeated sales count each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, by_value, shuffle_width

by_value(__name__)

RANGE_BITS = 17
RANGE_SECONDS = 1 << RANGE_BITS
FAN_BITS = 4  # FAN = 16 pieces are merged in a task and round
SUPER_BITS = 13
BUFFER = 1 << 21
GATHER_ROWS = 50_000
UNKNOWN, EVERYWHERE = -1, -2
DAY = 86_400

PIECE = (
    "nation int, range long, slot int, first long, open_sum long, cents_sum long, open_top long, cents_top long, "
    "at array<int>, open array<long>, cents array<long>"
)
KEYS = ["nation", "range", "slot"]

#: nation, moment, change of the count, change of the money; sorted by the first two, which do not repeat
Function = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def utc_seconds(df: DataFrame, name: str, unit: int = 1) -> Column:
    """A timestamp column as whole seconds since 1970, rounded down to multiples of ``unit``.
    Times without a zone are taken as UTC, whatever the session's zone is."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        since = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
        parts = " + ".join(f"extract({part} FROM {since}) * {size}" for part, size in (("DAY", DAY), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)))
        seconds = F.floor(F.expr(parts))
    else:
        seconds = F.floor(F.unix_micros(F.col(f"`{name}`").cast("timestamp")) / 1_000_000)
    return (F.floor(seconds / unit) * unit if unit != 1 else seconds).cast("long")


def compact(nation: np.ndarray, at: np.ndarray, opened: np.ndarray, cents: np.ndarray) -> Function:
    """Changes in any order as a function: one entry a moment, none that changes nothing."""
    order = np.lexsort((at, nation))
    nation, at = nation[order], at[order]
    if not len(at):
        return nation, at, opened, cents
    starts = np.flatnonzero(np.concatenate(([True], (nation[1:] != nation[:-1]) | (at[1:] != at[:-1]))))
    opened, cents = np.add.reduceat(opened[order], starts), np.add.reduceat(cents[order], starts)
    live = (opened != 0) | (cents != 0)
    return nation[starts][live], at[starts][live], opened[live], cents[live]


def added(f: Function, g: Function) -> Function:
    return compact(*(np.concatenate(pair) for pair in zip(f, g, strict=True)))


class Tree:
    """Adds functions pairwise, those of like size with each other."""

    def __init__(self) -> None:
        self.held: list[Function] = []

    def push(self, f: Function) -> None:
        while self.held and len(self.held[-1][1]) <= len(f[1]):
            f = added(self.held.pop(), f)
        self.held.append(f)

    def size(self) -> int:
        return sum(len(f[1]) for f in self.held)

    def take(self) -> Function | None:
        total = None
        while self.held:
            total = self.held.pop() if total is None else added(self.held.pop(), total)
        return total


def as_pieces(f: Function | None, slot: int) -> Iterator[pa.RecordBatch]:
    """A function cut by (nation, range), one row a piece with its totals and highest points."""
    if f is None or not len(f[1]):
        return
    nation, at, opened, cents = f
    cell = at >> RANGE_BITS
    starts = np.flatnonzero(np.concatenate(([True], (nation[1:] != nation[:-1]) | (cell[1:] != cell[:-1]))))
    ends = np.append(starts[1:], len(at))
    tops = []
    for values in (opened, cents):
        running = np.cumsum(values)
        before = running[starts] - values[starts]
        tops.append((np.add.reduceat(values, starts), np.maximum.reduceat(running, starts) - before))
    cuts = pa.array(np.append(starts, ends[-1]).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(cuts, pa.array(values))
        for values in ((at & (RANGE_SECONDS - 1)).astype(np.int32), opened, cents)
    ]
    flat = [
        nation[starts].astype(np.int32), cell[starts], np.full(len(starts), slot, np.int32), at[starts],
        tops[0][0], tops[1][0], tops[0][1], tops[1][1],
    ]
    names = ["nation", "range", "slot", "first", "open_sum", "cents_sum", "open_top", "cents_top", "at", "open", "cents"]
    yield pa.RecordBatch.from_arrays([*map(pa.array, flat), *lists], names=names)


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of one task's intervals (nation, start, end or null, cents)."""
    part, tree, rows = TaskContext.get().partitionId(), Tree(), []

    def gathered() -> None:
        if not rows:
            return
        whole = pa.Table.from_batches(rows)
        rows.clear()
        nation, start, cents = (whole.column(c).to_numpy() for c in ("nation", "start", "cents"))
        end = whole.column("end")
        ends = end.is_valid().to_numpy()
        one = np.ones(len(start), np.int64)
        n, t = np.concatenate((nation, nation[ends])), np.concatenate((start, end.drop_null().to_numpy()))
        opened, money = np.concatenate((one, -one[ends])), np.concatenate((cents, -cents[ends]))
        own = compact(n, t, opened, money)
        tree.push(own)
        tree.push(compact(np.full(len(own[1]), EVERYWHERE, own[0].dtype), *own[1:]))

    waiting = 0
    for batch in batches:
        rows.append(batch)
        waiting += batch.num_rows
        if waiting >= GATHER_ROWS:
            gathered()
            waiting = 0
            if tree.size() >= BUFFER:
                yield from as_pieces(tree.take(), part)
    gathered()
    yield from as_pieces(tree.take(), part)


def function_of(row: dict, nation: int, cell: int) -> Function:
    at = row["at"].values.to_numpy().astype(np.int64) + (cell << RANGE_BITS)
    return np.full(len(at), nation, np.int32), at, row["open"].values.to_numpy(), row["cents"].values.to_numpy()


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (nation, range, slot), those of one key added pairwise."""
    key, tree = None, Tree()
    for batch in batches:
        columns = {c: batch.column(c) for c in ("at", "open", "cents")}
        for i, own in enumerate(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True)):
            if own != key:
                if key is not None:
                    yield from as_pieces(tree.take(), key[2])
                key = own
            tree.push(function_of({c: columns[c][i] for c in columns}, own[0], own[1]))
    if key is not None:
        yield from as_pieces(tree.take(), key[2])


def tree_merge(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """One piece for each (nation, range), in rounds of FAN pieces a task."""
    name = "pieces"
    pieces = scratch.cut(pieces, name)
    slots = (pieces.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        lifted = pieces.withColumn("slot", F.shiftright("slot", FAN_BITS))
        dealt = lifted.repartition(shuffle_width(pieces.sparkSession), *KEYS).sortWithinPartitions(*KEYS)
        slots, last = -(-slots // (1 << FAN_BITS)), name
        name = f"merged_{slots}"
        pieces = scratch.cut(dealt.mapInArrow(merged, PIECE), name)
        scratch.drop(last)
        if slots == 1:
            return pieces


def carried(pieces: DataFrame) -> DataFrame:
    """What each piece starts from: counts and money open before it, the highest count so
    far, the first moment after it, and its nation's largest sum of money."""
    sums = pieces.select(*[c for c in pieces.columns if c not in ("at", "open", "cents", "slot")], F.shiftright("range", SUPER_BITS).alias("super"))
    here = Window.partitionBy("nation", "super").orderBy("range")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select(
        "nation", "super", "range", "first", "open_sum", "cents_sum",
        F.coalesce(F.sum("open_sum").over(past), F.lit(0)).alias("open_in"),
        F.coalesce(F.sum("cents_sum").over(past), F.lit(0)).alias("cents_in"),
        F.lead("first").over(here).alias("next_first"), "open_top", "cents_top",
    ).withColumns({"open_top": F.col("open_in") + F.col("open_top"), "cents_top": F.col("cents_in") + F.col("cents_top")})
    inner = inner.withColumn("high_in", F.max("open_top").over(past))
    outer = inner.groupBy("nation", "super").agg(
        F.sum("open_sum").alias("s_open"), F.sum("cents_sum").alias("s_cents"), F.max("open_top").alias("s_open_top"),
        F.max("cents_top").alias("s_cents_top"), F.min("first").alias("s_first"),
    )
    along = Window.partitionBy("nation").orderBy("super")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumns({
        "b_open": F.coalesce(F.sum("s_open").over(earlier), F.lit(0)),
        "b_cents": F.coalesce(F.sum("s_cents").over(earlier), F.lit(0)),
        "b_next": F.lead("s_first").over(along),
    })
    outer = outer.select(
        F.col("nation").alias("o_nation"), F.col("super").alias("o_super"), "b_open", "b_cents", "b_next",
        F.max(F.col("b_open") + F.col("s_open_top")).over(earlier).alias("b_high"),
        F.max(F.col("b_cents") + F.col("s_cents_top")).over(Window.partitionBy("nation")).alias("peak"),
    )
    joined = inner.join(outer.hint("merge"), (F.col("nation") == F.col("o_nation")) & (F.col("super") == F.col("o_super")))
    return joined.select(
        F.col("nation").alias("c_nation"), F.col("range").alias("c_range"),
        (F.col("b_open") + F.col("open_in")).alias("from_open"), (F.col("b_cents") + F.col("cents_in")).alias("from_cents"),
        F.greatest("b_high", F.col("b_open") + F.col("high_in")).alias("from_high"),
        F.coalesce("next_first", "b_next").alias("next_first"), "peak",
    )


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lowest = np.iinfo(np.int64).min
    for batch in batches:
        rows = batch.select([c for c in batch.schema.names if c not in ("at", "open", "cents")]).to_pylist()
        for i, row in enumerate(rows):
            f = function_of({c: batch.column(c)[i] for c in ("at", "open", "cents")}, row["nation"], row["range"])
            at, opened, cents = f[1], np.cumsum(f[2]) + row["from_open"], np.cumsum(f[3]) + row["from_cents"]
            high = np.maximum.accumulate(np.maximum(opened, lowest if row["from_high"] is None else row["from_high"]))
            after = pa.concat_arrays([pa.array(at[1:]), pa.array([row["next_first"]], pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(f[0]), pa.array(at), after, pa.array(opened), pa.array(cents), pa.array(high), pa.array(cents == row["peak"])],
                names=["nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak"],
            )


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, scratch: Scratch, unit: int = 1, days: int = 1) -> DataFrame:
    """Intervals (nation, start, end, cents) of the sales that are ever open.

    The line and client sides have one row a key and are written first, so the joins stand
    directly on their exchanges and adaptive execution splits a hot client or null key.
    """
    shipped = lines.select(F.col("sale_id").alias("l_sale"), utc_seconds(lines, "shipped_at", unit).alias("shipped")).filter("l_sale is not null and shipped is not null")
    ends = scratch.cut(shipped.groupBy("l_sale").agg((F.min("shipped") + days * DAY).alias("end")), "ends")
    known = clients.filter("client_id is not null").select(F.col("client_id").alias("c_client"), F.col("nation_id").cast("int").alias("nation"))
    places = scratch.cut(known.groupBy("c_client").agg(F.min("nation").alias("nation")), "places")
    total = F.col("total").cast("double")
    cents = F.when(F.abs(total) < F.lit(float("inf")), F.floor(100 * total + 0.5)).otherwise(0)
    starts = sales.select("sale_id", "client_id", utc_seconds(sales, "sold_at", unit).alias("start"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents")).filter("start is not null")
    dated = starts.join(ends.hint("merge"), F.col("sale_id") == F.col("l_sale"), "left").filter("end is null or end > start").select("client_id", "start", "end", "cents")
    placed = dated.join(places.hint("merge"), F.col("client_id") == F.col("c_client"), "left")
    return placed.select(F.coalesce("nation", F.lit(UNKNOWN)).alias("nation"), "start", "end", "cents")


def sweep(intervals: DataFrame, scratch: Scratch) -> DataFrame:
    """Moments at which what is open changes, by nation and for all (EVERYWHERE).

    ``intervals`` has nation int, start long, end long or null (for ever) and cents long. The
    result has nation_id, from_s, to_s, n_open, open_cents, high_open and is_peak.
    """
    pieces = tree_merge(intervals.mapInArrow(built, PIECE), scratch)
    carry = carried(pieces)
    whole = pieces.join(carry.hint("merge"), (F.col("nation") == F.col("c_nation")) & (F.col("range") == F.col("c_range")))
    wanted = whole.select("nation", "range", "at", "open", "cents", "from_open", "from_cents", "from_high", "next_first", "peak")
    return wanted.mapInArrow(unrolled, "nation_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean")
