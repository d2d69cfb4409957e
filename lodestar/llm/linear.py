"""Hashed linear scorers: feature extraction, fitting on the driver, scoring.

Features are hashed into 2^BITS weights, so a fitted model is a vector of fixed
size whatever the vocabulary. Fitting takes a bounded sample of labelled rows
(the bound is the caller's parameter); scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestar.llm import wordhash as wh

BITS = 18
SOFT = 0.15


def word_features(data, offsets, is_word=wh.ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words a row: (feature, row, words a row, word hashes)."""
    folded = wh.fold_latin(data)
    starts, stops, splits = wh.words(folded, offsets, is_word)
    hashes = wh.hash_words(folded, starts, stops)
    counts = np.diff(splits)
    rows = np.repeat(np.arange(len(counts)), counts)
    key = (rows << BITS) | (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
    key = np.unique(key)
    return key & ((1 << BITS) - 1), key >> BITS, counts, hashes


def word_feature(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    h = wh.hash_words(wh.fold_latin(raw), np.array([0]), np.array([len(raw)]))
    return int(h[0] & np.uint64((1 << BITS) - 1))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, weights=self.weights[features], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    features: np.ndarray, rows: np.ndarray, target: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = (),
    weight: np.ndarray | None = None, l2: float = 2e-4, l1: float = 2e-5, pair_penalty: float = 1.0, iterations: int = 200,
    rate: float = 0.1,
) -> Linear:
    """Logistic regression by full-batch Adam with soft thresholding.

    ``pairs`` are counterfactual edits (features out, features in, one entry per
    edited row as (row ids, feature ids, signs)): the squared change of a row's
    logit under its edit is added to the loss, so weights that only tell one
    identity term from another shrink together.
    """
    n = len(target)
    weight = np.ones(n) if weight is None else weight
    weight = weight / max(1e-12, weight.sum())
    used, local = np.unique(features, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    edits = []
    for edit_rows, edit_features, signs in pairs:
        at = np.searchsorted(used, edit_features)
        at = np.minimum(at, max(0, len(used) - 1))
        known = used[at] == edit_features if len(used) else np.zeros(0, bool)
        edits.append((edit_rows[known], at[known], signs[known]))
    for t in range(1, iterations + 1):
        z = np.bincount(rows, weights=w[local], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = (p - target) * weight
        g = np.bincount(local, weights=err[rows], minlength=len(w)) + l2 * w
        for edit_rows, at, signs in edits:
            if len(at):
                k = int(edit_rows.max()) + 1
                change = np.bincount(edit_rows, weights=w[at] * signs, minlength=k)
                g += pair_penalty * np.bincount(at, weights=2 * change[edit_rows] * signs, minlength=len(w)) / k
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    out = np.zeros(1 << BITS)
    out[used] = w
    return Linear(out, float(b))


def recalibrate(model: Linear, p: np.ndarray, target: np.ndarray, threshold: float) -> Linear:
    """Shift the bias so that ``threshold`` is the cut with the best F1.

    Decisions are softened over SOFT logits, so a cut inside a cluster of nearly
    equal scores is no better than a guess: weights that a penalty has shrunk to
    almost nothing cannot decide.
    """
    if not 0 < target.sum() < len(target):
        return model
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    best, where = -1.0, []
    for cut in np.linspace(z.min(), z.max(), 201):
        soft = 1 / (1 + np.exp(-np.clip((z - cut) / SOFT, -30, 30)))
        f1 = 2 * (soft * target).sum() / (soft.sum() + target.sum())
        if f1 > best + 1e-3:
            best, where = f1, []
        if f1 > best - 1e-3:
            where.append(cut)
    return Linear(model.weights, model.bias + float(np.log(threshold / (1 - threshold)) - np.median(where)))
