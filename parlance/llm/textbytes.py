"""Whole-batch text scanning on Arrow buffers.

Arrow keeps a string column as one run of UTF-8 bytes and a list of offsets, so
words, hashes and n-grams of a whole batch come from a few numpy passes with no
Python loop over rows.  Work is cut into runs of rows of about ``limit`` bytes
so that temporary arrays stay small; a text longer than that is a run by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
RUN_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but space and tab to carriage return.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def runs(column: pa.Array | pa.ChunkedArray, limit: int = RUN_BYTES, max_rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive runs of rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None and blob.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n, first + max_rows)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; none crosses a row."""
    inside = is_word[data]
    filled = offsets[:-1] < offsets[1:]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][filled]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][filled] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _powers[k]
            while len(have) < n:
                have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
            _powers[k] = have
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result (a bijection)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x + U64(0x9E3779B97F4A7C15))
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
        return x[()]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes that doesn't depend on its place."""
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts] + mix((ends - starts).astype(U64)))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Longer spans are left to zlib, one by one.
LONG_SPAN = 48


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span's bytes, going on from ``before`` where given: one step a byte place for all spans."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG_SPAN + 1).astype(np.int16), kind="stable")
    at, sorted_size = starts[order], np.minimum(size[order], LONG_SPAN + 1)
    register = ~(np.zeros(len(size), np.uint32) if before is None else before[order])
    left = np.searchsorted(-sorted_size, -np.arange(LONG_SPAN + 1), "left")  # how many spans have a byte at each place
    for k in range(LONG_SPAN):
        if not (n := left[k]):
            break
        register[:n] = _CRC[(register[:n] ^ data[at[:n] + k]) & 0xFF] ^ (register[:n] >> 8)
    out = np.empty(len(size), np.uint32)
    out[order] = ~register
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], 0 if before is None else int(before[i]))
    return out


def row_shingles(row: np.ndarray, hashes: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words per row, ordered by row and hash.

    A row of fewer words, but not none, is one shingle of all its words.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    size = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    ends = np.cumsum(size)
    of, value = np.repeat(np.arange(n_rows), size), np.empty(size.sum(), U64)
    with np.errstate(over="ignore"):
        tail = len(hashes) - width + 1
        if tail > 0:
            runs = np.zeros(tail, U64)
            for k in range(width):
                runs += hashes[k : k + tail]
                runs = mix(runs)
            value[(count >= width)[of]] = runs[row[:tail] == row[width - 1 :]]
        for k in range(1, width):
            rows = np.flatnonzero(count == k)
            if len(rows):
                short = np.full(len(rows), U64(0xA5A5_0000 + k))
                for j in range(k):
                    short = mix(short + hashes[first[rows] + j])
                value[ends[rows] - 1] = short
    # a row's values lie together, and many short sorts are quicker than a long one by two keys
    many = np.flatnonzero(size > 1)
    for a, b in zip((ends - size)[many].tolist(), ends[many].tolist(), strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[keep], value[keep]
