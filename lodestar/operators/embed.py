"""Hashing embedder: signed feature hashing of word n-grams.

A text's vector depends on that text alone, so it is made where the row is: tokens, counts,
hashes and the norm over Arrow batches, no shuffle.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

try:  # Python's own MD5: terms are short, and OpenSSL's set-up costs more than the hash
    from _md5 import md5
except ImportError:
    from hashlib import md5

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module
DIM = 512
TOKENS = 1 << 20  # tokens that are counted at a time
BYTES = 1 << 22  # of text that is cut into tokens at a time
ROWS = 1024  # rows whose positions are filled at a time


def slots(terms: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and sign of each term: the first four MD5 bytes, big-endian, modulo the
    dimension; +1 when the fifth byte is even, else -1. The recipe is a fixed value."""
    plain = terms.cast(pa.binary()).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join([md5(t).digest() for t in plain]), np.uint8).reshape(-1, 16)
    places = raw[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    return places % dim, np.where(raw[:, 4] % 2 == 0, 1.0, -1.0)


def _grams(tokens: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, terms): every n-gram of the rows, as a number of the distinct ones."""
    flat = tokens.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy().astype(np.int64))
    at, held, names = np.arange(len(codes)), codes, words
    rows, numbers, terms, n_terms = [], [], [], 0
    for n in range(1, max(sizes) + 1):
        if n > 1:
            at, held = at[at + n <= len(codes)], held[at + n <= len(codes)]
            inside = row[at] == row[at + n - 1]
            at, held = at[inside], held[inside]
            pairs = pa.array(held * len(words) + codes[at + n - 1]).dictionary_encode()
            held = pairs.indices.to_numpy().astype(np.int64)
            front, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(words)))
            names = pc.binary_join_element_wise(names.take(pa.array(front)), words.take(pa.array(last)), " ")
        if n in sizes:
            rows.append(row[at])
            numbers.append(held + n_terms)
            terms.append(names)
            n_terms += len(names)
    return np.concatenate(rows), np.concatenate(numbers), pa.concat_arrays(terms)


def _filled(tokens: pa.Array, dim: int, sizes: tuple[int, ...]):
    """(weights, present), rows by positions, of runs of rows: sign * (1 + ln tf), summed by
    position, of unit length."""
    ends, lo = np.cumsum(pc.list_value_length(tokens).to_numpy().astype(np.int64)), 0
    while lo < len(tokens):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
        row, number, terms = _grams(tokens.slice(lo, hi - lo), sizes)
        pos, sign = slots(terms, dim)
        keys, tf = np.unique(row * max(1, len(terms)) + number, return_counts=True)
        row, number = np.divmod(keys, max(1, len(terms)))
        cell, x = row * dim + pos[number], sign[number] * (1.0 + np.log(tf))
        for first in range(0, hi - lo, ROWS):
            n = min(ROWS, hi - lo - first)
            mine = slice(*np.searchsorted(row, (first, first + n)))
            weights = np.bincount(cell[mine] - first * dim, x[mine], n * dim).reshape(n, dim)
            present = np.bincount(cell[mine] - first * dim, minlength=n * dim).reshape(n, dim) > 0
            size = np.sqrt((weights * weights).sum(axis=1))
            yield weights / np.where(size > 0, size, 1.0)[:, None], present
        lo = hi


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _tokens(texts: pa.Array, pattern: str) -> pa.Array:
    """What ``text.hash_tokens`` finds, of texts in lower case."""
    find = re.compile(pattern).findall
    return pa.array([find(x) for x in texts.to_pylist()], pa.list_(pa.string()))


def _vectors(texts: pa.Array, pattern: str, dim: int, sizes: tuple[int, ...]):
    """What ``_filled`` gives for texts in lower case; the tokens of a whole batch are never held."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right")))
        yield from _filled(_tokens(texts.slice(lo, hi - lo), pattern), dim, sizes)
        lo = hi


def sparse_column(text: Column, dim: int = DIM, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """array<struct<pos, w>>, sorted by position."""

    pattern = T.HASH_TOKEN

    @F.arrow_udf("array<struct<pos:int,w:double>>")
    def cells(texts: pa.Array) -> pa.Array:
        pos, w, sizes_of = [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(1, np.int32)]
        for weights, present in _vectors(texts, pattern, dim, sizes):
            pos.append(np.nonzero(present)[1].astype(np.int32))
            w.append(weights[present])
            sizes_of.append(present.sum(axis=1).astype(np.int32))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(pos)), pa.array(np.concatenate(w))], ["pos", "w"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes_of), dtype=np.int32)), flat)

    return cells(lowered(text))


def dense_column(text: Column, dim: int = DIM, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """array<double> of length dim; zeros for a text without tokens."""

    pattern = T.HASH_TOKEN

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        out, at = np.empty((len(texts), dim)), 0
        for weights, _ in _vectors(texts, pattern, dim, sizes):
            out[at : at + len(weights)] = weights
            at += len(weights)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return vectors(lowered(text))


def row_maker(dim: int = DIM, sizes: tuple[int, ...] = (1, 2)):
    """A function from lower-case texts, as an Arrow array, to runs of their vectors in order;
    for tasks that use vectors where they are made."""
    pattern = T.HASH_TOKEN

    def rows(texts: pa.Array):
        for weights, _ in _vectors(texts, pattern, dim, sizes):
            yield weights

    return rows


def sparse_rows(
    df: DataFrame, id_col: str, text_col: str = "text", dim: int = DIM, sizes: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """(id, cells array<struct<pos, w>>) of every row, empty for texts without tokens."""
    return df.select(F.col(id_col).alias("id"), sparse_column(F.col(text_col), dim, sizes).alias("cells"))


def sparse_vectors(
    df: DataFrame, id_col: str, text_col: str = "text", dim: int = DIM, sizes: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """(id, pos, w): unit vectors of sign * (1 + ln tf) summed by position.

    Rows without tokens have no entries; a vector that cancels out keeps its zeros.
    """
    made = sparse_rows(df, id_col, text_col, dim, sizes)
    # outer: a plain explode infers a filter that makes the vectors a second time
    return made.select("id", F.explode_outer("cells").alias("e")).filter("e is not null").select("id", "e.pos", "e.w")


def packed_vectors(
    df: DataFrame, id_col: str, text_col: str = "text", dim: int = DIM, sizes: tuple[int, ...] = (1, 2)
) -> DataFrame:
    """(id, embedding array<double>) of every row, zero vectors for texts without tokens."""
    return df.select(F.col(id_col).alias("id"), dense_column(F.col(text_col), dim, sizes).alias("embedding"))
