"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D), so multi-byte
code points are never cut.  Each word gets a 64-bit hash: a polynomial in an odd base modulo 2**64
over randomised byte values, finished by an avalanche step.  All arithmetic wraps on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_ROOM = CHUNK + (1 << 16)
_BASE = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values; a bijection, so distinct values stay distinct."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), dtype=_U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Tables:
    """Byte values and powers, made once per task."""

    def __init__(self) -> None:
        self.byte = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
        self.size = 0
        self.grow(_ROOM)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.up = powers(_BASE, n)
            self.down = powers(pow(_BASE, -1, 2**64), n)
            self.size = n


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null reads as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    values = pc.fill_null(values.cast(pa.large_string()), "")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(values: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row stands alone)."""
    _, offsets = column(values)
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), len(offsets) - 1)
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, and the n+1 word offsets of the rows.

    Works through the bytes in pieces cut at white space, so memory beyond the words themselves
    doesn't grow with the length of a text (a single word longer than a piece apart).
    """
    total = len(data)
    first = np.zeros(total + 1, dtype=bool)
    first[offsets] = True  # a row's first byte never continues the word before it
    starts, ends, hashes = [], [], []
    at = 0
    while at < total:
        stop = at + CHUNK
        while stop < total:
            gap = np.flatnonzero(SPACE[data[stop : stop + CHUNK]] | first[stop : stop + CHUNK][: total - stop])
            if len(gap):
                stop += int(gap[0])
                break
            stop += CHUNK
        stop = min(stop, total)
        part = data[at:stop]
        tables.grow(len(part))
        solid = ~SPACE[part]
        edge = solid.copy()
        edge[1:] &= ~solid[:-1] | first[at + 1 : stop]
        begin = np.flatnonzero(edge)
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[at + 1 : stop]
        end = np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum(tables.byte[part] * tables.up[: len(part)], out=sums[1:])
        starts.append(begin + at)
        ends.append(end + at)
        hashes.append(mix((sums[end] - sums[begin]) * tables.down[begin]))
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    end = np.concatenate(ends) if ends else np.empty(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.empty(0, _U)
    return start, end, value, np.searchsorted(start, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of bounded pieces of a stream of batches."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text))
        for low, high in slices(values, most):
            piece = batch.slice(low, high - low)
            yield piece, *column(piece.column(batch.schema.get_field_index(text)))
