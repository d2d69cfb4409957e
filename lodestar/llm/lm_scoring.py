"""Language-model scores by stupid backoff, from the corpus itself.

A document is scored by the n-gram counts of all other documents: its own
occurrences are left out. With c the remaining counts and N the remaining words,

    S(w | u v) = c(uvw) / c(uv)             if c(uvw) > 0
                 BACKOFF * S(w | v)         else, and so on down to
    S(w)       = c(w) / N                   if c(w) > 0
                 BACKOFF / (N + 1)          else

and a document's score is the sum of log S over its words.

Relational plan: documents are dealt into batches by hash. Each batch explodes its
n-grams and sends every distinct one once, with its count, to the partition of the
n-gram's hash (so a word that fills a third of the corpus costs one record a
batch). There the batches' records are summed into the count table, and each batch
gets the totals of its own n-grams back. The batch joins them to its exploded
n-grams and sums per document. Records travel packed: sorted hashes as
differences, compressed. Nothing is gathered on the driver but the word total.

N-grams are told apart by HASH_BITS-bit hashes: with M distinct n-grams a given one
shares its count with another with a chance of M / 2^HASH_BITS (5e-8 for half a
gigabyte of text).

Cases: null, empty or blank text has no words and scores 0.0 with a null mean; with
no other document every word gets BACKOFF^(ORDER-1 or less) * BACKOFF / (N + 1);
repeated rows count as documents of their own; long texts are scored whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordhash as wh
from lodestar.llm.common import by_value, shuffle_width

ORDER = 3
BACKOFF = 0.4
HASH_BITS = 52
BATCH_BYTES = 8 << 20
BUCKETS_A_PARTITION = 4

REQUEST = "bucket int, batch int, gram int, body binary"
RESPONSE = "batch int, gram int, bucket int, body binary"


def grams(words: np.ndarray, splits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the last word) of every n-gram inside one document."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(splits) - 1), np.diff(splits))
    last = np.arange(n - 1, len(words))
    last = last[rows[n - 1 :] == rows[: len(words) - n + 1]]
    with np.errstate(over="ignore"):
        h = np.zeros(len(last), np.uint64)
        for j in range(n):
            h += words[last - j] * wh.SHINGLE_FACTORS[8 * n + j]
        h = wh.splitmix(h + np.uint64(n))
    return h >> np.uint64(64 - HASH_BITS), last


def document_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and row splits: A-Z lower-cased, words end at white space."""
    parts, splits, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b in wh.steps(offsets):
        low = wh.LOWER[data[offsets[a] : offsets[b]]]
        starts, stops, s = wh.words(low, offsets[a : b + 1] - offsets[a], wh.NOT_SPACE)
        parts.append(wh.hash_words(low, starts, stops))
        splits.append(s[1:] + base)
        base += len(starts)
    return np.concatenate(parts), np.concatenate(splits)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so a sorted list splits into runs."""
    return ((h >> np.uint64(HASH_BITS - 30)) * np.uint64(buckets)) >> np.uint64(30)


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of unsigned values: equal-weight bytes together, for compression."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def pack(*columns: np.ndarray) -> bytes:
    n = len(columns[0])
    raw = np.array([n], "<u8").tobytes() + b"".join(_planes(c) for c in columns)
    size = np.array([len(raw)], "<u8").tobytes()
    return size + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes, columns: int) -> list[np.ndarray]:
    size = int(np.frombuffer(body[:8], "<u8")[0])
    raw = np.frombuffer(pa.decompress(body[8:], decompressed_size=size, codec="zstd"), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    return [_unplanes(raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)], n) for i in range(columns)]


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def batch_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("text")
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return wh.text_buffers(column)


def distinct_grams(words: np.ndarray, splits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..ORDER the sorted distinct n-grams of a batch and their counts."""
    return [np.unique(grams(words, splits, n)[0], return_counts=True) for n in range(1, ORDER + 1)]


def requests_of(buckets: int):
    def requests(batch: pa.Table) -> pa.Table:
        words, splits = document_words(*batch_texts(batch))
        number = batch.column("batch")[0].as_py()
        out: list[tuple] = []
        for n, (h, count) in enumerate(distinct_grams(words, splits), 1):
            where = bucket_of(h, buckets).astype(np.int64)
            ends = np.searchsorted(where, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(ends)):
                a, b = ends[k], ends[k + 1]
                out.append((int(k), number, n, pack(gaps(h[a:b]), count[a:b].astype(np.uint64))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        columns = list(zip(*out)) if out else [[], [], [], []]
        names = ["bucket", "batch", "gram", "body"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return requests


def count_table(batches):
    """Per (bucket, n): sum the batches' counts and answer each batch's list.

    The rows come sorted by bucket and n, so one bucket is held at a time.
    """

    def answers(key, held):
        lists = [unpack(body, 2) for _, body in held]
        hashes = [np.cumsum(g, dtype=np.uint64) for g, _ in lists]
        every = np.concatenate(hashes)
        counts = np.concatenate([c for _, c in lists])
        distinct, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)[place]
        ends = np.cumsum([len(x) for x in hashes])
        rows = [
            (number, key[1], key[0], pack(total[e - len(x) : e])) for (number, _), x, e in zip(held, hashes, ends)
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["batch", "gram", "bucket", "body"]
        )

    key, held = None, []
    for batch in batches:
        for bucket, number, n, body in zip(*[batch.column(c).to_pylist() for c in ("bucket", "batch", "gram", "body")]):
            if key is not None and key != (bucket, n):
                yield answers(key, held)
                held = []
            key = (bucket, n)
            held.append((number, body))
    if held:
        yield answers(key, held)


def score_batch(words, splits, distinct, totals, corpus_words: int):
    """(words, sum of log scores, n-grams found by order) of each document."""
    n_docs = len(splits) - 1
    sizes = np.diff(splits)
    rows = np.repeat(np.arange(n_docs), sizes)
    rest = []  # for n: count outside the document at each word, 0 where the n-gram does not fit
    for n in range(1, ORDER + 1):
        h, last = grams(words, splits, n)
        place = np.searchsorted(distinct[n - 1], h)
        doc = rows[last]
        key = doc * np.int64(max(1, len(distinct[n - 1]))) + place
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        left = np.zeros(len(words), np.int64)
        left[last] = totals[n - 1][place].astype(np.int64) - own[inverse]
        rest.append(left)
    others = (corpus_words - sizes)[rows].astype(float)
    score = np.log(np.where(rest[0] > 0, rest[0] / np.maximum(1.0, others), BACKOFF / (others + 1.0)))
    level = np.where(rest[0] > 0, 1, 0)
    for n in range(2, ORDER + 1):
        fits = np.arange(len(words)) - splits[rows] >= n - 1
        seen = rest[n - 1] > 0
        context = np.ones(len(words), np.int64)
        context[1:] = rest[n - 2][:-1]
        score = np.where(seen, np.log(np.where(seen, rest[n - 1], 1) / np.where(seen, context, 1)), np.where(fits, score + np.log(BACKOFF), score))
        level = np.where(seen, n, level)
    found = [np.bincount(rows, weights=level == n, minlength=n_docs).astype(np.int64) for n in range(ORDER + 1)]
    return sizes, np.bincount(rows, weights=score, minlength=n_docs), found


def scores_of(corpus_words: int):
    def scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "n_words", "log_score", "mean_log_score"] + [f"found_{n}" for n in range(ORDER + 1)]
        kinds = [docs.schema.field("id").type, pa.int64(), pa.float64(), pa.float64()] + [pa.int64()] * (ORDER + 1)
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        words, splits = document_words(*batch_texts(docs))
        distinct = [h for h, _ in distinct_grams(words, splits)]
        got = sorted(zip(*[answers.column(c).to_pylist() for c in ("gram", "bucket", "body")]), key=lambda x: x[:2])
        totals = [
            np.concatenate([np.zeros(0, np.uint64), *[unpack(body, 1)[0] for g, _, body in got if g == n]])
            for n in range(1, ORDER + 1)
        ]
        sizes, total, found = score_batch(words, splits, distinct, totals, corpus_words)
        mean = pa.array(total / np.maximum(1, sizes), mask=sizes == 0)
        return pa.Table.from_arrays(
            [docs.column("id").combine_chunks(), pa.array(sizes), pa.array(total), mean, *[pa.array(x) for x in found]], names=names
        )

    return scores


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, found_0..found_ORDER) of every row.

    ``found_n`` counts the words scored by an n-gram (0: by the floor).
    """
    by_value("lodestar.llm.wordhash")
    by_value("lodestar.llm.lm_scoring")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')")
    size = docs.agg(F.sum(F.octet_length("text")), F.sum(words)).first()
    corpus_words = int(size[1] or 0)
    n_batches = max(1, -(-int(size[0] or 0) // batch_bytes))
    width = shuffle_width(spark)
    buckets = width * BUCKETS_A_PARTITION
    # the place in the scan only breaks ties between repeated rows
    batch = F.pmod(F.xxhash64("id", "text"), F.lit(n_batches)).cast("int")
    batched = docs.select(batch.alias("batch"), "id", "text")
    asked = batched.groupBy("batch").applyInArrow(requests_of(buckets), REQUEST)
    answered = (
        asked.repartition(width, "bucket").sortWithinPartitions("bucket", "gram", "batch").mapInArrow(count_table, RESPONSE)
    )
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, n_words bigint, log_score double, mean_log_score double, " + ", ".join(
        f"found_{n} bigint" for n in range(ORDER + 1)
    )
    scored = batched.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(scores_of(corpus_words), schema)
    return scored.withColumnRenamed("id", id_col)
