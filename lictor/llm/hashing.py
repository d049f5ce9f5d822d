"""Words of Arrow text columns and their hashes, vectorised over whole batches.

A word hash is a sum of byte x position multiplier modulo 2**64 (multilinear hashing), mixed once more; a sequence hash
is the same over word hashes. Multipliers come from a fixed rule, so hashes agree on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x.astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers of the given seed."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTES = multipliers(256, 11)
_WORDS = multipliers(64, 12)


def _byte_multipliers(n: int) -> np.ndarray:
    global _BYTES
    if len(_BYTES) < n:
        _BYTES = multipliers(2 * n, 11)
    return _BYTES


def _word_multipliers(n: int) -> np.ndarray:
    global _WORDS
    if len(_WORDS) < n:
        _WORDS = multipliers(2 * n, 12)
    return _WORDS


def _class(separators) -> np.ndarray:
    inside = np.ones(256, np.uint8)
    inside[list(separators)] = 0
    return inside


#: Words of `[^\x20\x09-\x0D]+`.
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, taken after lower-casing A-Z.
ALPHANUMERIC = _class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Tokens: runs of letters and digits, and runs of other visible characters.
TOKENS = np.where(SPACED, np.where(ALPHANUMERIC, 1, 2), 0).astype(np.uint8)
TOKENS[:0x20] = TOKENS[0x7F] = 0
TOKENS[0x41:0x5B] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of a batch of texts. Text i owns words[bounds[i]:bounds[i + 1]]; starts and ends are byte offsets in data."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i]:self.bounds[i + 1]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None and held.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, inside: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Maximal runs of bytes of one class; class 0 separates."""
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    kind = inside[data]
    first = offsets[:-1][np.diff(offsets) > 0]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first] = after[first[1:] - 1] = 0
    flags = kind > 0
    starts = np.flatnonzero(flags & (kind != before))
    ends = np.flatnonzero(flags & (kind != after)) + 1
    bounds = np.searchsorted(starts, offsets)
    sizes = ends - starts
    if not len(starts):
        return Words(data, starts, ends, bounds, np.empty(0, U))
    where = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(where, sizes)
    with np.errstate(over="ignore"):
        parts = (data[flags].astype(U) + U(1)) * _byte_multipliers(int(sizes.max()))[at]
        hashes = mixed(np.add.reduceat(parts, where) + sizes.astype(U))
    return Words(data, starts, ends, bounds, hashes)


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, U)
    by = _word_multipliers(size)
    with np.errstate(over="ignore"):
        total = np.full(n, U(size))
        for j in range(size):
            total += hashes[j:j + n] * by[j]
    return mixed(total)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, sorted; a shorter text is one shingle, a text without words has none."""
    if not len(hashes):
        return np.empty(0, U)
    return np.unique(sequences(hashes, min(size, len(hashes))))


def lists(values: np.ndarray, sizes, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def small(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` text bytes, so that memory does not depend on the length of texts."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.diff(utf8(texts)[1])
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held + size > most and i > begin:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


_POWERS = (np.ones(1, U), np.ones(1, U))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.r_[U(1), np.full(2 * n, U(b))]) for b in (_BASE, _INVERSE))
    return _POWERS


class Segments:
    """Hashes of any runs of words, from running sums over one batch."""

    def __init__(self, hashes: np.ndarray):
        forward, self.back = _powers(len(hashes) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.r_[U(0), np.cumsum(hashes * forward[:len(hashes)])]

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(U))
