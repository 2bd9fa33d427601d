"""Texts as numpy arrays: word and line bounds, 64-bit hashes of words and of word sequences.

Everything works on one bounded slice of an Arrow batch at a time, so a task holds a few
megabytes of text at once, or one text if a single one is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..runtime import give_back

SLICE_BYTES = 1 << 19
# Longer words are hashed by a digest: powers modulo 2**64 take some long words of a regular build for equal.
LONG_WORD = 256
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def separators(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


# The white space that ends a word: space and the codes 9 to 13.
WORD_ENDS = separators([0x20, *range(0x09, 0x0E)])
LINE_ENDS = separators([0x0A])
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64; the longest asked for are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = -(-n // (1 << 16)) << 16
        made = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 1 << 20:  # for one very long text; not kept
            return made[0][:n], made[1][:n]
        _POWERS[base] = made[0], made[1]
    up, down = _POWERS[base]
    return up[:n], down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of each run values[start:end], equal for equal runs wherever they stand."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * _U(0xD1B54A32D192ED03))


class Texts:
    """One slice of texts: the bytes, each text's bounds, and the words on demand. A null text is empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.n = len(column)

    def pieces(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end) of the maximal runs of bytes that are not separators."""
        inside = ~ends[self.bytes]
        size = len(inside)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:size]
        last[:-1] &= ~inside[1:] | edge[1:size]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        return np.searchsorted(self.offsets, starts, side="right") - 1, starts, stops

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end, hash) of every word."""
        doc, starts, ends = self.pieces(WORD_ENDS)
        hashes = range_hashes(_BYTES[self.bytes], starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            hashes[k] = np.frombuffer(hashlib.blake2b(self.bytes[starts[k] : ends[k]], digest_size=8).digest(), np.uint64)[0]
        return doc, starts, ends, hashes

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end) of every line, blank ones included, ends without the line feed."""
        feed = np.flatnonzero(LINE_ENDS[self.bytes])
        starts = np.concatenate([self.offsets[:-1], feed + 1])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, feed, side="right") - 1])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        if len(ends):
            ends[-1] = self.offsets[-1]
        final = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        ends[final] = self.offsets[doc[final] + 1]
        return doc, starts, ends


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts come to about `limit` bytes; a longer text is a slice of its own."""
    try:
        yield from _slices(batches, column, limit)
    finally:  # also of a task that is ended early
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch


def counts_of(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def bounds_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the items of each text in an array ordered by text."""
    return np.searchsorted(doc, np.arange(n + 1))


def spans_to_list(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
