"""Text columns as flat arrays: words, hashes and shingles for whole Arrow batches.

Python tasks here get Arrow batches and work on the bytes of all texts at once.
Every batch is cut into pieces of a few megabytes first, so that memory stays
bounded whatever the batch size of the session; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 3_000_000
CACHE_BYTES = 1_000_000  # for work of many steps on wide numbers, which is faster near the processor
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pieces_of(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes together."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts; null is empty."""
    filled = pc.fill_null(column, "")
    if pa.types.is_large_string(filled.type):
        width = np.int64
    else:
        width = np.int32
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = filled.buffers()
    starts = np.frombuffer(offsets, width)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, starts - starts[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true flags; a run never crosses a row start."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 2**64)
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def slice_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices; equal bytes give equal hashes wherever they stand."""
    size = 1 << max(10, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MULTIPLIERS[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def row_of(begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row that each slice lies in."""
    return np.searchsorted(starts, begin, side="right") - 1


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words per row and the number of them.

    Rows with fewer words give the whole sequence as one shingle where ``short``
    is set, and none otherwise; rows without words give none.
    """
    firsts = np.cumsum(counts) - counts
    full = np.maximum(counts - width + 1, 0)
    at = expand(firsts, full)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mix(out + hashes[at + k] + np.uint64(k + 1))
    if not short:
        return out, full
    some = (counts > 0) & (full == 0)
    number = full + some
    if not some.any():
        return out, number
    places = np.cumsum(number) - number
    merged = np.empty(int(number.sum()), np.uint64)
    merged[expand(places, full)] = out
    for row in np.flatnonzero(some):
        value = np.zeros(1, np.uint64)
        for h in hashes[firsts[row] : firsts[row] + counts[row]]:
            value = mix(value + h + np.uint64(77))
        merged[places[row]] = value[0]
    return merged, number


def expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0]+1, ... for each row, ``counts`` of them, all in one array."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    step = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(firsts - step, counts)


def distinct_in_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, and how many each has."""
    rows = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.bincount(rows[keep], minlength=len(counts)).astype(np.int64)


def distinct_together(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``distinct_in_rows`` by one sort of single numbers.

    The row takes the upper bits and the value loses as many lower ones, 64 less
    the bits of the number of rows are left. Values can be compared within the call.
    """
    bits = np.uint64(max(1, len(counts).bit_length()))
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    both = np.sort(rows << (np.uint64(64) - bits) | values >> bits)
    both = both[np.concatenate((np.ones(min(1, len(both)), bool), both[1:] != both[:-1]))]
    number = np.bincount((both >> (np.uint64(64) - bits)).astype(np.int64), minlength=len(counts)).astype(np.int64)
    return both << bits, number


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
