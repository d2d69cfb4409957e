"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Their votes
are counted by pattern over all documents, and expectation-maximisation finds
each heuristic's accuracy and the share of good documents from those counts (a
table bounded by 3^heuristics, whatever the corpus). The posterior of each vote
pattern then labels a bounded sample (``TRAIN_ROWS``, ``TRAIN_BYTES``) on which a hashed linear
scorer is trained; that scorer decides.

Cases: null and empty texts get no votes and are scored like any other text without
words; ids may be null or repeated, equal texts get equal scores; columns named
``quality_votes``, ``quality_score`` and ``quality_keep`` give way to those made here; an
empty table gives an empty result; if every pattern has the same posterior all rows get
it as their score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import linear
from lodestar.llm import wordhash as wh
from lodestar.llm.common import by_value
from lodestar.llm.html_text import STOP_WORDS

TRAIN_ROWS = 20_000
TRAIN_BYTES = 256 << 20  # of the texts of the sample
KEEP = 0.5
WEIGHT_DECAY = 1e-5
NAMES = ("symbols", "shouting", "stutter", "variety", "bars", "exclaims", "sentences", "stop_words")
BUCKETS = 16
SHAPES = 1 << 16  # places of the token shapes
WINDOW = 500  # words
WORD_SCREEN = 4.0  # standard errors by which a word must be more or less frequent in good rows
WORD_LEAST = 5  # sampled rows that hold a word that counts

_b = np.arange(256)
UPPER = (_b >= 65) & (_b <= 90)
LETTER = UPPER | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
PLAIN = LETTER | ((_b >= 48) & (_b <= 57)) | np.isin(_b, np.frombuffer(b".,;:'\"!?()-|", np.uint8))


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row x heuristic) measures and the number of words a row."""
    n_rows = len(offsets) - 1

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    solid = wh.NOT_SPACE[data]
    n_solid = np.maximum(1, total(solid))
    starts, stops, splits = wh.words(data, offsets, wh.NOT_SPACE)
    hashes = wh.hash_words(wh.fold_latin(data), starts, stops)
    counts = np.diff(splits)
    rows = np.repeat(np.arange(n_rows), counts)
    n_words = np.maximum(1, counts).astype(float)
    by_row = lambda flags: np.bincount(rows, weights=flags, minlength=n_rows)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    # distinct words by windows of one length, as their share falls with the length of what is counted
    place = np.arange(len(hashes)) - np.repeat(splits[:-1], counts)
    window = rows * (1 << 32) + place // WINDOW
    distinct = np.bincount(wh.distinct_by_row(hashes, window)[1] >> 32, minlength=n_rows) if len(hashes) else np.zeros(n_rows)
    bars = (stops - starts == 1) & (data[starts] == ord("|")) if len(starts) else np.zeros(0)
    out = np.stack(
        [
            total(solid & ~PLAIN[data]) / n_solid,
            total(UPPER[data]) / np.maximum(1, total(LETTER[data])),
            by_row(same) / n_words,
            distinct / n_words,
            by_row(bars) / n_words,
            total(data == ord("!")) / n_words,
            total(data == ord(".")) / n_words,
            by_row(np.isin(hashes, _stop_hashes())) / n_words,
        ],
        axis=1,
    )
    return out, counts


def _stop_hashes() -> np.ndarray:
    global _STOPS
    if _STOPS is None:
        out = []
        for word in sorted(STOPS_SHIPPED):
            raw = wh.fold_latin(np.frombuffer(word.encode(), np.uint8))
            out.append(wh.hash_words(raw, np.array([0]), np.array([len(raw)]))[0])
        _STOPS = np.array(out, np.uint64)
    return _STOPS


STOPS_SHIPPED = STOP_WORDS
_STOPS: np.ndarray | None = None


def votes(m: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-1 bad, 0 no vote, 1 good; (row x heuristic)."""
    symbols, shouting, stutter, variety, bars, exclaims, sentences, stops = m.T
    some, many = counts >= 3, counts >= 30

    def vote(bad, good):
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack(
        [
            vote(some & (symbols > 0.10), some & (symbols < 0.03)),
            vote(some & (shouting > 0.40), some & (shouting < 0.15)),
            vote((counts >= 8) & (stutter > 0.15), many & (stutter < 0.04)),
            vote(many & (variety < 0.22), many & (variety > 0.40)),
            vote((counts >= 8) & (bars > 0.08), some & (bars < 0.01)),
            vote((counts >= 8) & (exclaims > 0.15), some & (exclaims < 0.03)),
            vote(many & (sentences < 0.004), many & (sentences > 0.03)),
            vote(many & (stops < 0.02), many & (stops > 0.08)),
        ],
        axis=1,
    )


@dataclass
class LabelModel:
    prior: float  # share of good documents
    good: np.ndarray  # heuristic x (bad, none, good): chance of each vote on a good document, given that it votes
    bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        # a heuristic that does not vote says nothing
        at = np.arange(patterns.shape[1])
        told = np.log(self.good[at, patterns + 1]) - np.log(self.bad[at, patterns + 1])
        ratio = np.log(self.prior / (1 - self.prior)) + np.where(patterns == 0, 0.0, told).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(ratio, -50, 50)))

    def accuracies(self) -> np.ndarray:
        right = self.prior * self.good[:, 2] + (1 - self.prior) * self.bad[:, 0]
        wrong = self.prior * self.good[:, 0] + (1 - self.prior) * self.bad[:, 2]
        return right / np.maximum(1e-12, right + wrong)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, iterations: int = 100) -> LabelModel:
    """Accuracies from vote patterns alone: starts from the vote balance."""
    k = patterns.shape[1]
    if not len(patterns):
        even = np.ones((k, 3))
        return LabelModel(0.95, even, even)
    balance = patterns.clip(-1, 1)
    start = np.where((balance < 0).any(axis=1), 0.3, 0.95)
    p, counts = start, counts.astype(float)
    for _ in range(iterations):
        total = max(1e-9, counts.sum())
        g, b = counts * p, counts * (1 - p)
        prior = float(np.clip(g.sum() / total, 0.05, 0.99))
        tables = []
        for w in (g, b):
            t = np.stack([[(w * (patterns[:, j] == v)).sum() for v in (-1, 0, 1)] for j in range(k)])
            t = t + np.array([0.5, 0.5, 0.5]) * max(1.0, 1e-4 * total)
            t[:, 1] = 0.0
            t = t / t.sum(axis=1, keepdims=True)
            t[:, 1] = 1.0
            tables.append(t)
        model = LabelModel(prior, *tables)
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-7:
            break
        p = new
    return model


def scorer_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row: bucketed measures, common token shapes and distinct words."""
    m, counts = measures(data, offsets)
    word, word_row, _, _ = linear.word_features(data, offsets)
    n_rows = len(counts)
    bucket = np.minimum(BUCKETS - 1, np.floor(np.sqrt(np.clip(m, 0, 1)) * BUCKETS)).astype(np.int64)
    rows = np.repeat(np.arange(n_rows), m.shape[1])
    named = np.arange(m.shape[1])[None, :] * BUCKETS + bucket
    parts, part_rows = [named.ravel()], [rows]
    shape = np.where(UPPER[data], 65, np.where(LETTER[data], 97, np.where(PLAIN[data], 46, 37))).astype(np.uint8)
    if len(shape) > 1:
        starts, stops, splits = wh.words(data, offsets, wh.NOT_SPACE)
        if len(starts):
            first, last = shape[starts], shape[stops - 1]
            kind = first.astype(np.int64) * 256 + last
            word_rows = np.repeat(np.arange(n_rows), np.diff(splits))
            key, seen = np.unique((word_rows << 16) | kind, return_counts=True)
            row = key >> 16
            share = np.floor(8 * seen / np.maximum(1, counts[row])).astype(np.int64)
            with np.errstate(over="ignore"):
                mixed = wh.splitmix(((key & 0xFFFF) * 16 + share).astype(np.uint64))
            parts.append(1024 + (mixed % np.uint64(SHAPES)).astype(np.int64))
            part_rows.append(row)
    # words have the places after those of the measures and shapes
    parts.append(1024 + SHAPES + word % ((1 << linear.BITS) - 1024 - SHAPES))
    part_rows.append(word_row)
    return np.concatenate(parts), np.concatenate(part_rows)


def telling(features: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Flags of the features that count: all but words that good and bad rows have alike."""
    wide = 1 << linear.BITS
    good = max(1e-9, float(target.sum()))
    bad = max(1e-9, len(target) - good)
    seen = np.bincount(features, minlength=wide)
    in_good = np.bincount(features, weights=target[rows], minlength=wide)
    share = seen / max(1, len(target))
    error = np.sqrt(np.maximum(1e-12, share * (1 - share)) * (1 / good + 1 / bad))
    apart = np.abs(in_good / good - (seen - in_good) / bad) > WORD_SCREEN * error
    counted = apart & (seen >= WORD_LEAST)
    counted[: 1024 + SHAPES] = True
    return counted


def _ship() -> None:
    for name in ("wordhash", "linear", "html_text", "quality"):
        by_value(f"lodestar.llm.{name}")


def votes_column(text: Column) -> Column:
    """The votes as a string of '-', '0', '+', one character a heuristic."""
    _ship()

    @F.arrow_udf("string")
    def vote(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        out: list[str] = []
        for a, b in wh.steps(offsets):
            v = votes(*measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            letters = np.array(["-", "0", "+"])[v + 1]
            out += ["".join(x) for x in letters]
        return pa.array(out, pa.string())

    return vote(text)


def scorer_features_column(text: Column) -> Column:
    _ship()

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in wh.steps(offsets):
            f, r = scorer_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            order = np.argsort(r, kind="stable")
            flat.append(f[order].astype(np.int32))
            sizes.append(np.bincount(r, minlength=b - a))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(flat)))

    return features(text)


def score_column(text: Column, model: linear.Linear) -> Column:
    _ship()
    small = linear.Linear(model.weights.astype(np.float32), model.bias)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        out = [np.zeros(0)]
        for a, b in wh.steps(offsets):
            f, r = scorer_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out.append(small.scores(f, r, b - a))
        return pa.array(np.concatenate(out))

    return score(text)


def pattern_array(strings) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in s] for s in strings], dtype=int).reshape(-1, len(NAMES))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: linear.Linear


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> QualityModel:
    voted = docs.select(votes_column(F.col(text_col)).alias("v"))
    counted = voted.groupBy("v").count().collect()  # at most 3^heuristics rows
    patterns = pattern_array([r["v"] for r in counted])
    label_model = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    # a bounded sample: the rows with the smallest hashes
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    sizes = docs.select(key.alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"))
    total, chosen = 0, {}
    for r in sizes.orderBy("h").limit(train_rows).collect():
        total += r["size"]
        if total > train_bytes and chosen:
            break
        chosen[r["h"]] = True
    sample = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in chosen], "h bigint"))
    got = (
        docs.select(key.alias("h"), F.col(text_col).alias("t")).join(sample, "h")
        .select("h", votes_column(F.col("t")).alias("v"), scorer_features_column(F.col("t")).alias("f"))
        .groupBy("h").agg(F.first("v").alias("v"), F.first("f").alias("f")).orderBy("h").toArrow()
    )
    n = got.num_rows
    if not n:
        return QualityModel(label_model, linear.Linear(np.zeros(1 << linear.BITS), 0.0))
    lists = got.column("f").combine_chunks()
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    target = label_model.posterior(pattern_array(got.column("v").to_pylist()))
    good = max(1e-9, target.sum())
    weight = target / good + (1 - target) / max(1.0, n - good)
    features = lists.flatten().to_numpy()
    kept = telling(features, rows, target)[features]
    features, rows = features[kept].astype(np.int64), rows[kept]
    del got, lists
    scorer = linear.fit(features, rows, target, (), weight, l2=WEIGHT_DECAY, l1=0.0, iterations=300)
    return QualityModel(label_model, scorer)


def classify_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row of docs with ``quality_votes``, ``quality_score`` and ``quality_keep``."""
    model = train(docs, text_col, id_col, train_rows)
    return (
        docs.withColumn("quality_votes", votes_column(F.col(text_col)))
        .withColumn("quality_score", score_column(F.col(text_col), model.scorer))
        .withColumn("quality_keep", F.col("quality_score") >= F.lit(KEEP))
    )
