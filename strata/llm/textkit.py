"""Byte-level text kernels on Arrow string columns, shared by the operators.

Words are ``[^\\x20\\x09-\\x0D]+``.  All separators are ASCII, so words, word hashes and
n-grams are found on the UTF-8 bytes of many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call works on (a single longer text is taken whole).
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_BYTE_CODE = mix64(np.arange(256, dtype=np.uint64)) | np.uint64(1)
_BYTE_CODE[_SEPARATOR] = 0
_BASE = np.uint64(0x9FB21C651E98DF25)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < n:
        size = max(SLICE_BYTES + 1, n)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 1 << 22:
            _tables[name] = table
    return table[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes, or one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    blank = _SEPARATOR[data]
    first = ~blank
    last = first.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    begin = offsets[:-1][offsets[:-1] < n]
    first[begin] = ~blank[begin]
    final = offsets[1:][offsets[1:] > 0] - 1
    last[final] = ~blank[final]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix64(segment_hashes(_BYTE_CODE, data, starts))


def segment_hashes(code: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the bytes from each start to the next one, whose codes are ``code``; a byte of code 0 counts only by the place it takes."""
    n = len(data)
    return np.add.reduceat(code[data] * _powers("up", _BASE, n), starts) * _powers("down", _BASE_INVERSE, n)[starts]


def ngrams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each document and n + 1 offsets; a document of fewer words has one window of all its words, of no word none."""
    counts = np.diff(first)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    windows = np.maximum(counts - k + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(windows)))
    padded = np.concatenate((hashes, np.zeros(k - 1, np.uint64)))
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], windows)
    left = np.repeat(first[1:], windows) - at
    out = padded[at].copy()
    for j in range(1, k):
        word = padded[at + j]
        word[left <= j] = 0
        out = out * _STEP + word
    return mix64(out), offsets


def slice_batches(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes and offsets of one text column."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in slices(offsets):
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
