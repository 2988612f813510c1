"""Vectorised text kernels on the bytes of Arrow string columns.

Every operator that reads whole texts in Python uses these: a batch becomes one byte array with
document offsets, and words, hashes and rolling windows are arrays over it.  Work goes in slices of
a few MB so that memory stays bounded by the longest document, not by the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
MASK64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
TEXT_WORD = np.ones(256, dtype=bool)
TEXT_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all beyond ASCII.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def trim() -> None:
    """Give back to the system what finished work has left: Python workers stay between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte, made by rule.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least; the longest rows asked for are kept."""
    for known, rows in _POWERS.items():
        if known >= n:
            return rows
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _POWERS:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.empty(size + 1, dtype=np.uint64)
            row[0], done, step = 1, 1, base
            while done <= size:  # double the known part
                take = min(done, size + 1 - done)
                row[done : done + take] = row[:take] * np.uint64(step)
                done += take
                step = step * step & MASK64
            out.append(row)
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i; ranges of it give order-aware hashes."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the range stands."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut to about `most` bytes of text (one document at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each document the index of its first word (n + 1 values)."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def owner(firsts: np.ndarray) -> np.ndarray:
    """For n + 1 first indexes: the document of each item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places some range covers."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def eights(data: np.ndarray) -> np.ndarray:
    """For each place but the last seven the number that eight bytes from it make, first byte highest."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def same_ranges(eight: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of `size` bytes (eight at least) from places a and b are equal, byte for byte."""
    out, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
    for at in range(0, int(size.max()) if len(size) else 0, 8):
        open_ = open_[out[open_] & (size[open_] > at)]
        step = np.minimum(at, size[open_] - 8)  # the last number overlaps the one before
        out[open_] = eight[a[open_] + step] == eight[b[open_] + step]
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
