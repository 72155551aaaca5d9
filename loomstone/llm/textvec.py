"""Vectorised word work on Arrow string columns: words are runs of bytes other than space and
\\x09-\\x0D, with A-Z lower-cased, each as one 64-bit hash. No Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(65, 91):
    _TABLE[_upper] = _TABLE[_upper + 32]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTS = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: each input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))])
    return _powers


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word) of the words of all rows."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~_IS_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (ascending, not overlapping, none empty)."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        lo, hi = starts[at], ends[to - 1]
        s = starts[at:to] - lo
        length = ends[at:to] - starts[at:to]
        piece = _TABLE[data[lo:hi]]
        steps = np.arange(hi - lo, dtype=np.int64)
        gap = np.diff(np.append(s, hi - lo))
        steps -= np.repeat(s, gap)
        inside = steps < np.repeat(length, gap)
        piece = np.where(inside, piece, np.uint64(0))
        piece *= powers(int(gap.max()) + 1)[steps]
        out[at:to] = np.add.reduceat(piece, s) + length.astype(np.uint64)
        at = to
    return mix(out)


def byte_hashes(values: np.ndarray, place: int) -> np.ndarray:
    """What bytes at a place of their spans add to a hash."""
    return _TABLE[values] * powers(place + 1)[place]


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, in order."""
    data, offsets = column_bytes(column)
    starts, ends, row = words(data, offsets)
    return span_hashes(data, starts, ends), row


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words that lies in one row, in order."""
    count = len(hashes) - n + 1
    if count <= 0:
        return hashes[:0], row[:0]
    total = np.full(count, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * _MULTS[k]
    same = row[:count] == row[n - 1 :]
    return mix(total[same]), row[:count][same]


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a short sequence of words, in the domain of `grams`."""
    total = np.full(1, np.uint64(len(hashes)), dtype=np.uint64)
    for k in range(len(hashes)):
        total += hashes[k : k + 1] * _MULTS[k]
    return mix(total)[0]


def per_row(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Bounds so that row i has values[bounds[i]:bounds[i + 1]]; row ascends."""
    return np.searchsorted(row, np.arange(n_rows + 1))
