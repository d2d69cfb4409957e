"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word shingles. Equal sets form one class
and go on as one row. A class's shingles are dealt by hash into the G blocks of
a sketch, and the tokens of a block are XORed together, so two sketches differ in
at most as many blocks as the sets' symmetric difference has members. By the
pigeonhole principle two similar sets of one size band agree in some block;
agreeing blocks (an equi-join on block and value) give candidates, and the exact
Jaccard of the full sets verifies them.

Bands are [48*2^k, 48*2^(k+1)); a set in the top quarter of its band also joins
the next one. G grows with the band (1 to 3 tokens a block) and KEPT_BLOCKS of the
blocks are emitted: for a pair at exactly the threshold each agrees with a chance
of 0.39 at least, so all of them differ with a chance under 1e-10; closer pairs are
safer still. Smaller sets get one token a block and emit every block.

Candidates that parity bit sketches cannot exclude are verified nearest first:
pairs that verified links already connect need no check of their own.

Blocks that many classes share join through a few leaders first; after the first
components, pairs of classes that are in one such block but in different
components are compared by their sketches as well. The Hamming distance of two bit
sketches is a lower bound on the symmetric difference, so it excludes no link.

Class keys are 64-bit hashes of the sets. Cases: null text and text without words
have an empty set, link with nothing and are their own component; a text of fewer
words than a shingle is one shingle; repeated rows share a class; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.common import Scratch, bitmap, by_value, files_for, marked, shuffle_width
from lodestar.llm.graph import components

SHINGLE = 5
NUM, DEN = 75, 100  # linked when DEN * intersection >= NUM * union
ROW_SHIFT = 54  # row number above, 54 bits of shingle hash below
CHUNK_ROWS = 1000
SMALL, SMALL_BLOCKS, KEPT_BLOCKS = 48, 4096, 48
SKETCH_WORDS = 32  # 2048 parity bits
FULL_RUN, LEADERS = 6, 2
NEAREST_TURNS = 1
FILTER_BITS = 1 << 23  # fixed-size filter of the classes whose sets are needed

_HASH = np.uint64((1 << ROW_SHIFT) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 54-bit shingle hashes, sorted by row and hash, and their rows."""
    low = wh.LOWER[data]
    starts, stops, splits = wh.words(low, offsets, wh.NOT_SPACE)
    h, rows = wh.shingles(wh.hash_words(low, starts, stops), splits, k)
    key = np.sort((rows.astype(np.uint64) << np.uint64(ROW_SHIFT)) | (h >> np.uint64(64 - ROW_SHIFT)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _HASH, (key >> np.uint64(ROW_SHIFT)).astype(np.int64)


def chunks(offsets: np.ndarray):
    for a, b in wh.steps(offsets):
        for c in range(a, b, CHUNK_ROWS):
            yield c, min(b, c + CHUNK_ROWS)


def bands_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own band, next band or -1): band 0 below SMALL, then one a doubling."""
    own = np.where(sizes < SMALL, 0, 1 + np.floor(np.log2(np.maximum(1, sizes) / SMALL)).astype(np.int64))
    top = SMALL << own
    return own, np.where(sizes * DEN >= top * NUM, own + 1, -1)


def blocks_of_band(band: np.ndarray) -> np.ndarray:
    low = SMALL << np.maximum(0, band - 1)
    wide = np.maximum(KEPT_BLOCKS, (low * 2) // 3)
    return np.where(band <= 0, SMALL_BLOCKS, wide)


def block_signatures(h: np.ndarray, rows: np.ndarray, band_of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of each emitted block of each row that is in a band."""
    band = band_of_row[rows]
    here = band >= 0
    h, rows, band = h[here], rows[here], band[here]
    g = blocks_of_band(band).astype(np.uint64)
    block = ((h >> np.uint64(ROW_SHIFT - 32)) * g) >> np.uint64(32)  # rising with h: sorted input stays sorted
    kept = (band == 0) | (block < np.uint64(KEPT_BLOCKS))
    h, rows, band, block = h[kept], rows[kept], band[kept], block[kept]
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])]))
    with np.errstate(over="ignore"):
        value = np.bitwise_xor.reduceat(wh.splitmix(h), first)
        where = (band[first].astype(np.uint64) << np.uint64(32)) | block[first]
        return wh.splitmix(value ^ wh.splitmix(where + np.uint64(77))), rows[first]


def parity_bits(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """(row x SKETCH_WORDS): bit parities of the hashed tokens."""
    bits = SKETCH_WORDS * 64
    at = rows * bits + (wh.splitmix(h + np.uint64(5)) % np.uint64(bits)).astype(np.int64)
    odd = np.flatnonzero(np.bincount(at, minlength=n_rows * bits) & 1)
    out = np.zeros(n_rows * SKETCH_WORDS, np.uint64)
    np.bitwise_or.at(out, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return out.reshape(n_rows, SKETCH_WORDS)


def class_keys(h: np.ndarray, rows: np.ndarray, n_rows: int, counts: np.ndarray) -> np.ndarray:
    keys = np.zeros(n_rows, np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        with np.errstate(over="ignore"):
            keys[rows[first]] = np.add.reduceat(wh.splitmix(h + np.uint64(3)), first)
            keys = wh.splitmix(keys + counts.astype(np.uint64))
    return keys


FIELDS = "struct<n:bigint,key:bigint,sigs:array<bigint>,sketch:binary>"


def _ship() -> None:
    by_value("lodestar.llm.wordhash")
    by_value("lodestar.llm.ngram_join")


def profile_column(text: Column, k: int = SHINGLE) -> Column:
    """Set size, class key, block signatures and parity sketch of a text."""
    _ship()

    @F.arrow_udf(FIELDS)
    def profile(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        ns, keys, sketches, sigs, sizes = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in chunks(offsets):
            h, rows = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            counts = np.bincount(rows, minlength=b - a)
            own, above = bands_of(counts)
            own = np.where(counts < 2, -1, own)
            above = np.where(counts < 2, -1, above)
            s1, r1 = block_signatures(h, rows, own)
            s2, r2 = block_signatures(h, rows, above)
            s, r = np.concatenate([s1, s2]), np.concatenate([r1, r2])
            order = np.argsort(r, kind="stable")
            ns.append(counts)
            keys.append(class_keys(h, rows, b - a, counts))
            sketches.append(parity_bits(h, rows, b - a))
            sigs.append(s[order].view(np.int64))
            sizes.append(np.bincount(r, minlength=b - a))
        n = len(offsets) - 1
        count = np.concatenate(ns) if ns else np.zeros(0, np.int64)
        key = (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64)
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        sketch = np.concatenate(sketches) if sketches else np.zeros((0, SKETCH_WORDS), np.uint64)
        wide = SKETCH_WORDS * 8
        binary = pa.Array.from_buffers(
            pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(sketch.tobytes())]
        )
        return pa.StructArray.from_arrays(
            [pa.array(count.astype(np.int64)), pa.array(key, mask=count == 0),
             pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sigs))), binary],
            ["n", "key", "sigs", "sketch"],
        )

    return profile(text)


def _runs(batches, columns: list[str]):
    """Rows of each equal-signature run of a sorted partition, as arrays."""
    held = None
    for batch in batches:
        now = [batch.column(c) for c in columns]
        now = [x.to_numpy(zero_copy_only=False) for x in now]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now)]
        sig = now[0]
        if not len(sig):
            continue
        cuts = np.flatnonzero(sig[1:] != sig[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        last = int(starts[-1])
        yield [x[:last] for x in now], starts
        held = [x[last:] for x in now]
    if held is not None and len(held[0]):
        yield held, np.array([0, len(held[0])])


def similar_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def candidate_pairs(batches):
    """Pairs of classes in a block: all of a short run, leaders and neighbours of a long one."""
    for (sig, n, key), starts in _runs(batches, ["sig", "n", "key"]):
        left, right = [], []
        sizes = np.diff(starts)
        for size in np.unique(sizes[sizes > 1]):
            at = starts[:-1][sizes == size]
            if size <= FULL_RUN:
                i, j = np.triu_indices(int(size), 1)
            else:
                i = np.concatenate([np.full(size - 1 - x, x) for x in range(LEADERS)] + [np.arange(LEADERS, size - 1)])
                j = np.concatenate([np.arange(x + 1, size) for x in range(LEADERS)] + [np.arange(LEADERS + 1, size)])
            left.append((at[:, None] + i[None, :]).ravel())
            right.append((at[:, None] + j[None, :]).ravel())
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            ok = similar_size(n[a], n[b]) & (key[a] != key[b])
            a, b = key[a[ok]], key[b[ok]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        long = starts[:-1][sizes > FULL_RUN]
        if len(long):  # (sig, sig): marks a long run
            yield pa.RecordBatch.from_arrays([pa.array(sig[long]), pa.array(np.full(len(long), None), pa.int64())], ["a", "b"])


def leftover_pairs(batches):
    """Pairs of a long run that are in different components and that the parity
    sketches cannot exclude: Hamming distance at most (|A|+|B|)(DEN-NUM)/(DEN+NUM)."""
    for (sig, n, key, root, sketch), starts in _runs(batches, ["sig", "n", "key", "root", "sketch"]):
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2 or (root[s:e] == root[s]).all():
                continue
            bits = np.frombuffer(b"".join(sketch[s:e]), np.uint64).reshape(e - s, SKETCH_WORDS)
            size, roots, keys = n[s:e], root[s:e], key[s:e]
            for i in range(e - s - 1):
                j = i + 1 + np.flatnonzero((roots[i + 1 :] != roots[i]) & similar_size(size[i + 1 :], size[i]))
                if not len(j):
                    continue
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                j = j[apart * (DEN + NUM) <= (size[j] + size[i]) * (DEN - NUM)]
                if len(j):
                    a, b = np.minimum(keys[j], keys[i]), np.maximum(keys[j], keys[i])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def sets_of(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(key, set): the packed set of each needed class.

    ``docs`` has (id, text), ``needed`` has (key, rep), rep being the id of a row
    of the class. A bitmap of fixed size over the ids keeps most other rows from
    being packed; the join drops what it lets through in error.
    """
    _ship()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot("rep") % 64).cast("int"))
    words = (
        needed.groupBy(F.shiftright(slot("rep"), 6).alias("w")).agg(F.bit_or(bit).alias("bits")).collect()
    )  # FILTER_BITS / 64 rows at most
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        bitmap[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("struct<key:bigint,set:binary>")
    def packed(texts: pa.Array, slots: pa.Array) -> pa.Array:
        s = slots.to_numpy(zero_copy_only=False)
        wanted = ((shared.value[s >> 6] >> (s & 63)) & 1).astype(bool)
        data, offsets = wh.text_buffers(texts.filter(pa.array(wanted)))
        sets: list[bytes | None] = [None] * len(s)
        keys = np.zeros(len(s), np.int64)
        places = np.flatnonzero(wanted)
        for a, b in chunks(offsets):
            h, rows = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
            at = np.searchsorted(rows, np.arange(b - a + 1))
            keys[places[a:b]] = class_keys(h, rows, b - a, np.diff(at)).view(np.int64)
            for i in range(b - a):
                sets[places[a + i]] = h[at[i] : at[i + 1]].tobytes()
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(sets, pa.binary())], ["key", "set"])

    few = docs.select(packed(F.col("text"), slot("id")).alias("p")).filter("p.set is not null").select("p.key", "p.set")
    unique = few.groupBy("key").agg(F.first("set").alias("set"))
    return unique.join(needed.select("key"), "key", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    _ship()

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            out.append(DEN * common >= NUM * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").filter(linked("set_a", "set_b")).select("a", "b")


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, apart): the pairs that the parity sketches cannot exclude, with the
    share of the two sets that is at least different, in thousandths."""
    _ship()

    @F.arrow_udf("int")
    def apart(x: pa.Array, y: pa.Array, size: pa.Array) -> pa.Array:
        bits = [np.frombuffer(b"".join(z.to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS) for z in (x, y)]
        total = size.to_numpy(zero_copy_only=False)
        differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
        return pa.array((1000 * differ // total).astype(np.int32), mask=differ * (DEN + NUM) > total * (DEN - NUM))

    left = classes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", apart("x", "y", F.col("n_a") + F.col("n_b")).alias("apart")).filter("apart is not null")


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def join_components(pairs: DataFrame, check, scratch: Scratch) -> DataFrame:
    """(node, root): the components that all verified pairs would connect.

    First each class is checked against its closest candidate (NEAREST_TURNS times, each
    time outside its component), then every pair that is still between two components;
    pairs inside one component need no check. The components of a turn go into the next
    one as stars, so each turn takes few rounds.
    """
    left, roots = pairs, None
    files = files_for(pairs.sparkSession, pairs.count())
    for turn in range(NEAREST_TURNS + 1):
        if turn < NEAREST_TURNS:
            sides = left.select(F.col("a").alias("x"), "apart", "a", "b").unionByName(left.select(F.col("b").alias("x"), "apart", "a", "b"))
            chosen = sides.groupBy("x").agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
            chosen = scratch.cut(chosen, f"chosen_{turn}", files)
        else:
            chosen = left
        found = check(chosen, f"turn_{turn}")
        roots = components(found if roots is None else _as_edges(roots).unionByName(found), scratch, f"turn_{turn}")
        if turn == NEAREST_TURNS:
            break
        ra, rb = roots.select(F.col("node").alias("na"), F.col("root").alias("ra")), roots.select(F.col("node").alias("nb"), F.col("root").alias("rb"))
        left = scratch.cut(
            left.join(chosen, ["a", "b"], "left_anti")
            .join(ra, F.col("a") == F.col("na"), "left").join(rb, F.col("b") == F.col("nb"), "left")
            .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "apart"),
            f"left_{turn}", files,
        )
        scratch.drop(f"chosen_{turn}")
        if not left.limit(1).count():
            break
    return scratch.cut(roots, "roots", files)


def ngram_components(
    df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE
) -> DataFrame:
    """(id, n_shingles, set_key, component_id) of every row of df.

    ``scratch`` is this call's own: all of its tables but those that the result reads are removed.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiled = base.select("id", profile_column(F.col("text"), k).alias("p"))
    profiles = scratch.cut(profiled.select("id", "p.n", "p.key", "p.sigs", "p.sketch"), "profiles")
    classes = scratch.cut(
        profiles.filter("n > 0").groupBy("key")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sigs").alias("sigs"), F.first("sketch").alias("sketch")),
        "classes",
    )
    rows = scratch.cut(profiles.select("id", "n", "key"), "rows")
    scratch.drop("profiles")
    width = shuffle_width(spark)
    exploded = classes.select("n", "key", F.explode("sigs").alias("sig"))
    sorted_runs = exploded.repartition(width, "sig").sortWithinPartitions("sig", "n", "key").select("sig", "n", "key")
    found = scratch.cut(sorted_runs.mapInArrow(candidate_pairs, "a bigint, b bigint"), "found")
    pairs = scratch.cut(close_pairs(found.filter("b is not null").distinct(), classes), "pairs")
    long_runs = scratch.cut(found.filter("b is null").select(F.col("a").alias("sig")).distinct(), "long_runs")
    scratch.drop("found")

    def check(candidates: DataFrame, name: str) -> DataFrame:
        keys = candidates.select(F.col("a").alias("key")).unionByName(candidates.select(F.col("b").alias("key"))).distinct()
        n = candidates.count()
        reps = scratch.cut(classes.select("key", "rep").join(keys, "key", "left_semi"), f"reps_{name}", files_for(spark, 2 * n))
        sets = scratch.cut(sets_of(base, reps, k), f"sets_{name}", files_for(spark, 2 * n, 1000))
        links = scratch.cut(verified(candidates.select("a", "b"), sets), f"links_{name}", files_for(spark, n, 1000))
        scratch.drop(f"sets_{name}", f"reps_{name}")
        return links

    roots = join_components(pairs, check, scratch)
    rooted = classes.join(roots, F.col("key") == F.col("node"), "left").select(
        "n", F.col("key").alias("cls"), F.coalesce("root", "key").alias("root"), "sigs", "sketch"
    )
    # the bitmaps let some other blocks through, which changes nothing but the work
    shared = marked(rooted.select("root", F.explode("sigs").alias("key")), bitmap(long_runs.select(F.col("sig").alias("key"))))
    mixed = shared.filter("hit").groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = scratch.cut(mixed, "mixed")
    if mixed.limit(1).count():
        members = marked(rooted.select("n", "cls", "root", "sketch", F.explode("sigs").alias("key")), bitmap(mixed)).filter("hit")
        rest = (
            members.select(F.col("key").alias("sig"), "n", F.col("cls").alias("key"), "root", "sketch")
            .repartition(width, "sig").sortWithinPartitions("sig", "n", "key")
            .mapInArrow(leftover_pairs, "a bigint, b bigint").distinct()
        )
        more = check(scratch.cut(rest, "rest"), "rest")
        roots = components(_as_edges(roots).unionByName(more), scratch, "rest")
    named = classes.select("key", "rep").join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("root", "key").alias("root")
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    labels = scratch.cut(named.join(least, "root").select(F.col("key").alias("k2"), "component"), "labels")
    scratch.close("rows", "labels")
    return (
        rows.select("id", "n", "key").join(labels, F.col("key") == F.col("k2"), "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("set_key"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
