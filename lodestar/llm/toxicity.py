"""Toxicity scores from a counterfactually regularised linear classifier.

Hashed word features, screened for those that toxic rows have more often, and logistic
regression over these and all identity terms, fitted on a bounded sample of the labelled rows (``TRAIN_ROWS`` and ``TRAIN_BYTES``: the rows with the smallest id hashes). Every
training row that names a group is paired with copies in which the group term is
swapped for another of its list; the squared change of the logit is penalised,
so no group term can carry weight of its own and neutral mentions stay low. Identity terms
are not screened: the penalty, not their absence, is what keeps them level, and what they
seem to tell must be told by the other words. ``swap_gap`` measures what is left.

Cases: null or empty text scores as a text without words; ids that repeat in the
labels count once, by their mean label; an id that repeats in the documents is learnt from
once, by the text with the least hash; every row is scored; columns named ``held_out``,
``score`` and ``predicted`` give way to those made here; without labels of both kinds every score
is the share of toxic labels (0 when there are none); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import linear
from lodestar.llm import wordhash as wh
from lodestar.llm.common import by_value

TRAIN_ROWS = 30_000
TRAIN_BYTES = 256 << 20  # of the texts of the sample
THRESHOLD = 0.7
PAIR_PENALTY = 4.0
SCREEN = 3.5

# Terms for groups of people, by kind; each list ends in a neutral term.
IDENTITY_TERMS = (
    ("men", "women", "boys", "girls", "males", "females", "people"),
    ("man", "woman", "boy", "girl", "male", "female", "person"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender", "human"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "religious"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "believers"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "american"),
    ("immigrant", "refugee", "foreigner", "native", "citizen", "neighbour"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "neighbours"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "menschen"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "gens"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "personas"),
)


def swaps(features: np.ndarray, rows: np.ndarray, terms=IDENTITY_TERMS):
    """Counterfactual edits: (edit number, feature, sign) for each swap of a term."""
    edit_ids, edit_features, signs, n = [], [], [], 0
    for group in terms:
        ids = np.array([linear.word_feature(w) for w in group])
        for i, own in enumerate(ids):
            named = rows[features == own]
            if not len(named):
                continue
            for other in (ids[-1], ids[(i + 1) % len(ids)], ids[(i + 2) % len(ids)]):
                if other == own:
                    continue
                number = np.arange(n, n + len(named))
                n += len(named)
                edit_ids += [number, number]
                edit_features += [np.full(len(named), own), np.full(len(named), other)]
                signs += [np.full(len(named), -1.0), np.full(len(named), 1.0)]
    if not n:
        return []
    return [(np.concatenate(edit_ids), np.concatenate(edit_features), np.concatenate(signs))]


def telling(features, rows, target) -> np.ndarray:
    """Features that toxic rows have more often, by SCREEN standard errors."""
    n1 = target.sum()
    n0 = len(target) - n1
    in_toxic = np.bincount(features, weights=target[rows], minlength=1 << linear.BITS)
    in_all = np.bincount(features, minlength=1 << linear.BITS)
    share = in_all / len(target)
    error = np.sqrt(np.maximum(1e-12, share * (1 - share)) * (1 / n1 + 1 / n0))
    z = (in_toxic / n1 - (in_all - in_toxic) / n0) / error
    return (z > SCREEN) & (in_all >= 3)


def identity_features(terms=IDENTITY_TERMS) -> np.ndarray:
    """Which features are identity terms."""
    out = np.zeros(1 << linear.BITS, bool)
    out[[linear.word_feature(w) for group in terms for w in group]] = True
    return out


def swap_gap(model: linear.Linear, features: np.ndarray, rows: np.ndarray, n: int, terms=IDENTITY_TERMS) -> float:
    """Mean change of the score when a row's identity term is swapped for another; 0 without any."""
    gaps = []
    z = np.bincount(rows, weights=model.weights[features], minlength=n) + model.bias
    score = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for group in terms:
        ids = [linear.word_feature(w) for w in group]
        for own in ids:
            named = rows[features == own]
            for other in ids:
                if other != own and len(named):
                    gaps.append(np.abs(score(z[named] - model.weights[own] + model.weights[other]) - score(z[named])))
    return float(np.concatenate(gaps).mean()) if gaps else 0.0


def fit(features, rows, target, pair_penalty: float = PAIR_PENALTY, terms=IDENTITY_TERMS) -> linear.Linear:
    n = len(target)
    positive = float(target.sum())
    if not 0 < positive < n:
        return linear.Linear(np.zeros(1 << linear.BITS), 30.0 if n and positive == n else -30.0)
    weight = np.where(target == 1, 0.5 / positive, 0.5 / (n - positive))
    kept = (telling(features, rows, target) | identity_features(terms))[features]
    edits = swaps(features, rows, terms)
    model = linear.fit(features[kept], rows[kept], target, edits, weight, l2=2e-4, l1=0.0, pair_penalty=pair_penalty, iterations=300)
    return linear.recalibrate(model, model.scores(features, rows, n), target, THRESHOLD)


def _ship() -> None:
    by_value("lodestar.llm.wordhash")
    by_value("lodestar.llm.linear")


def word_features_column(text: Column) -> Column:
    _ship()

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        parts, sizes = [], []
        for a, b in wh.steps(offsets):
            f, r, _, _ = linear.word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(f.astype(np.int32))
            sizes.append(np.bincount(r, minlength=b - a))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))

    return features(text)


def score_column(text: Column, model: linear.Linear) -> Column:
    """Score of a text under a fitted model; the model is a vector of 2^BITS floats."""
    _ship()
    small = linear.Linear(model.weights.astype(np.float32), model.bias)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = wh.text_buffers(texts)
        out = []
        for a, b in wh.steps(offsets):
            f, r, _, _ = linear.word_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out.append(small.scores(f, r, b - a))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def train(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, pair_penalty: float = PAIR_PENALTY
) -> linear.Linear:
    """Fit on labelled rows outside the held-out third: at most ``train_rows`` ids, the
    first ``train_bytes`` of their texts by id hash."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    )
    # the sample has train_rows ids at most, so its broadcast is bounded
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(F.broadcast(sample), "doc_id")
    # one text an id, however many rows repeat it
    sizes = texts.groupBy("doc_id").agg(F.min(F.struct("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("m"))
    rows = sizes.select("doc_id", "m.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, chosen = 0, []
    for r in rows:
        total += r["size"]
        if total > train_bytes and chosen:
            break
        chosen.append((r["doc_id"], r["h"]))
    kind = dict(docs.dtypes)["doc_id"]
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, h bigint"))
    got = (
        texts.join(picked, ["doc_id", "h"]).select("doc_id", "h", "y", word_features_column(F.col("text")).alias("f"))
        .groupBy("doc_id", "h").agg(F.first("y").alias("y"), F.first("f").alias("f"))
        .toArrow()
    )
    lists = got.column("f").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    features = lists.flatten().to_numpy() if len(lists) else np.zeros(0, int)
    order_free = np.argsort(got.column("doc_id").to_numpy(), kind="stable") if len(lists) else np.zeros(0, int)
    rank = np.empty(len(order_free), int)
    rank[order_free] = np.arange(len(order_free))
    rows = np.repeat(rank, sizes)
    target = np.zeros(len(rank))
    target[rank] = got.column("y").to_numpy() if len(lists) else 0
    return fit(features, rows, target, pair_penalty)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, pair_penalty: float = PAIR_PENALTY) -> DataFrame:
    """Every row of docs with ``held_out``, ``score`` and ``predicted``."""
    model = train(docs, labels, train_rows, pair_penalty=pair_penalty)
    scored = docs.withColumn("score", score_column(F.col("text"), model))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
