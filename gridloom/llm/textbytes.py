"""Words and word hashes of whole Arrow text columns, by numpy over UTF-8 bytes.

A batch is cut into blocks of rows with about ``BLOCK`` bytes, so temporary
arrays stay small; one longer text is a block of its own and is never cut.
Nothing that a long text needs is held after it, and :func:`lean` gives memory
back when a task ends: a worker lives through many stages.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
_GOLD = 0x9E3779B97F4A7C15


def lean(run):
    """``run`` over Arrow batches, after which the allocators return what they no longer use."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + np.uint64(_GOLD)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(count: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


# Upper-case A-Z hash as their lower-case letters; other bytes as themselves.
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_BYTE = mix(_FOLD * np.uint64(0xD6E8FEB86659FD93))

# Words by white space: everything but space and the control characters 9 to 13.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

_STEP = 0xC2B2AE3D27D4EB4F
_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse; only tables for a block are kept."""
    if n <= BLOCK + 1 and _powers:
        return _powers
    made = []
    for base in (_STEP, _BACK):
        run = np.full(max(n, BLOCK + 1), np.uint64(base), dtype=np.uint64)
        run[0] = np.uint64(1)
        made.append(np.multiply.accumulate(run))
    if n <= BLOCK + 1:
        _powers[:] = made
    return made


def blocks(column: pa.Array, limit: int = BLOCK):
    """Yield (first row, last row, bytes, offsets) with offsets relative to the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = SPACED):
    """Starts, ends and per-row word offsets of the words of the rows of a block."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = w[heads]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    last[tails] = w[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z folded; equal words hash alike wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, back = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_GOLD)))
