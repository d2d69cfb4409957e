"""Vectorised word and shingle hashing over Arrow string columns.

Works on the UTF-8 bytes of a whole batch at once: no Python object per word.
Hashes are 64-bit; two different words or shingles collide with a chance of
about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # working set of one step; a longer text is a step of its own


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return splitmix(steps + np.uint64(seed))


BYTE_VALUES = stream(256, 1)
BASE = np.uint64(0x2545F4914F6CDD1D)
SHINGLE_FACTORS = stream(64, 2) | np.uint64(1)

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
SAME = _bytes.astype(np.uint8)
#: words end at space and the five ASCII controls 9-13
NOT_SPACE = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: words of letters and digits; every byte of a multi-byte character counts as a letter
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray):
    """Row ranges of about CHUNK_BYTES each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the Latin-1 capitals written in two bytes."""
    out = LOWER[data]
    if len(out) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(start, end, row splits) of the words; data is already case-folded."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    rows = offsets[:-1]
    before[rows[rows < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets).astype(np.int64)


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths  # each word's place among the word bytes
    within = np.arange(total) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
        sums = np.add.reduceat(BYTE_VALUES[data[at]] * powers[within], first)
        return splitmix(sums + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, splits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every k-word shingle; a row of fewer words has its whole
    sequence as its one shingle, a row without words none."""
    n_rows = len(splits) - 1
    counts = np.diff(splits)
    rows = np.repeat(np.arange(n_rows), counts)
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            sums = np.zeros(len(hashes) - k + 1, np.uint64)
            for j in range(k):
                sums += hashes[j : len(hashes) - k + 1 + j] * SHINGLE_FACTORS[j]
            whole = rows[: len(sums)] == rows[k - 1 :]
            out, out_rows = sums[whole], rows[: len(sums)][whole]
        else:
            out, out_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = counts[short] > j
                extra[has] += hashes[splits[short[has]] + j] * SHINGLE_FACTORS[j]
            extra += counts[short].astype(np.uint64) * SHINGLE_FACTORS[40]
            out, out_rows = np.concatenate([out, extra]), np.concatenate([out_rows, short])
        return splitmix(out), out_rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs sorted by row, then value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values) == 0:
        return values, rows
    new = np.empty(len(values), bool)
    new[0] = True
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]
