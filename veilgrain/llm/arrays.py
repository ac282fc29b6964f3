"""Whole Arrow columns of text as byte arrays, and hashes over their words, in numpy.

Every function works on a piece of a batch: a few megabytes of text made of whole
documents, so that memory in a task is bounded by the piece (or by one document).
Hashes have 64 bits, wrap around, and depend on nothing but the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GROWN: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept for pieces, made anew for longer texts."""
    usual = 2 * PIECE_BYTES + 1024
    if n <= usual and "up" in _GROWN:
        return _GROWN["up"], _GROWN["down"]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(max(n, usual), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= usual:
        _GROWN["up"], _GROWN["down"] = made
    return made[0], made[1]


def release() -> None:
    """Hand memory that a finished task has freed back to the machine; the worker lives on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values, with a leading zero."""
    up, _ = _powers(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) given the running sums; equal content, equal hash."""
    _, down = _powers(len(running))
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    at = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    release()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs free of space, tab, newline, vertical tab, form feed and return, and the row of each."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    edges = edges[inside[edges] & inside[edges - 1]]
    begins[edges] = True
    stops[edges - 1] = True
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a piece (case of A-Z ignored) and where each row's words begin (one more than rows)."""
    data = lower_ascii(data)
    starts, ends, row = words(data, offsets)
    hashes = span_hash(sums(BYTE_VALUES[data]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a row and the row of each; a row of fewer words gives one for all its words."""
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(len(counts)), counts)
    running = sums(hashes)
    at = np.arange(len(hashes))
    whole = at + n <= firsts[1:][rows]
    short = (at == firsts[:-1][rows]) & (counts[rows] < n)
    pick = np.flatnonzero(whole | short)
    ends = np.minimum(pick + n, firsts[1:][rows[pick]])
    return span_hash(running, pick, ends), rows[pick]
