"""The best k rows of every query, kept by a task while it scans its rows."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module
SLICE_ROWS, SLICE_SCORES = 1024, 1 << 20  # rows, and scores of theirs, that are held at a time
EMITTED = 10_000  # hits in one Arrow batch


def slice_rows(n_queries: int) -> int:
    """Rows whose scores are held at a time."""
    return max(16, min(SLICE_ROWS, SLICE_SCORES // max(1, n_queries)))


class Best:
    """Hits by score, then by ``ord``, nulls first; those below ``least`` do not come.

    What a task holds, and sends on, is at most some multiple of k hits a query, whatever the
    number of its rows. ``bound`` is the score below which a row cannot matter any more.
    """

    def __init__(self, n_queries: int, k: int, least: float = -np.inf):
        self.k, self.bound = k, np.full(n_queries, least)
        self.room = max(20_000, 4 * k * n_queries)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: pa.Array, order: pa.Array) -> None:
        """Scores, rows by queries, of rows with these ids and places."""
        n, n_queries = scores.shape
        if np.isnan(scores.sum()):
            scores = np.where(np.isnan(scores), np.inf, scores)  # no number ranks first, as in SQL
        hit = scores >= self.bound
        if n > self.k and np.count_nonzero(hit) > 4 * self.k * n_queries:
            hit &= scores >= np.partition(scores, n - self.k, axis=0)[n - self.k]  # ties at the cut stay
        row, q = np.nonzero(hit)
        if not len(row):
            return
        take = pa.array(row)
        named, placed = (c.take(take).to_numpy(zero_copy_only=False) for c in (ids, order))
        self.parts.append((q, scores[row, q], placed, named))
        self.held += len(row)
        if self.held > self.room:
            self.prune()

    def prune(self) -> None:
        if not self.parts:
            return
        q, score, placed, named = (np.concatenate(c) for c in zip(*self.parts))
        keys = [placed]
        if placed.dtype == object:
            known = np.array([x is not None for x in placed], bool)
            if not known.all():
                filler = placed[known][0] if known.any() else 0
                keys = [np.where(known, placed, filler), known]
        by = np.lexsort((*keys, -score, q))
        sorted_q = q[by]
        first = np.flatnonzero(np.append(True, sorted_q[1:] != sorted_q[:-1]))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        full = by[place == self.k - 1]
        self.bound[q[full]] = np.maximum(self.bound[q[full]], score[full])
        by = by[place < self.k]
        self.parts = [(q[by], score[by], placed[by], named[by])]
        self.held = len(by)

    def batches(self, query_ids: list, schema: pa.Schema):
        """What is held, as Arrow batches of query_id, id, ord, score."""
        self.prune()
        if not self.parts:
            return
        q, score, placed, named = self.parts[0]
        for lo in range(0, len(q), EMITTED):
            part = slice(lo, lo + EMITTED)
            shown = np.where(np.isinf(score[part]), np.nan, score[part])
            columns = [[query_ids[i] for i in q[part]], named[part], placed[part], shown]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
