"""Words of Arrow text columns as numpy arrays: bounds and 64-bit hashes, a few megabytes of text at a time.

Used inside tasks only. A word is a maximal run of word bytes of one row; every pattern needed here treats all
bytes of a multi-byte character alike, so runs of bytes and runs of characters are the same thing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text per piece; a longer row is a piece of its own.
PIECE = 1 << 20

_OTHER = np.ones(256, bool)
_OTHER[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = _OTHER
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and everything beyond ASCII.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        if n > 8 * PIECE:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Piece:
    """Some rows of a batch. ``row`` is the row of each word, counted from ``first``; ``stop[i]`` is the number of
    words up to the end of row ``i``; ``raw`` is the text as given and ``bounds`` the bytes of each row."""

    first: int
    rows: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    stop: np.ndarray
    hashes: np.ndarray
    raw: np.ndarray
    bounds: np.ndarray

    def text(self, word: int) -> str:
        return self.data[self.starts[word]:self.ends[word]].tobytes().decode()

    def begin(self, row: int) -> int:
        return int(self.stop[row - 1]) if row else 0


def pieces(column: pa.Array, table: np.ndarray, lower: bool) -> Iterator[Piece]:
    """The words of a string column, piece by piece; nulls have none."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PIECE, side="right")) - 1)
        b = min(b, len(column))
        yield _piece(a, whole[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], table, lower)
        a = b


def _piece(first: int, data: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool) -> Piece:
    raw = data
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Piece(first, len(bounds) - 1, data, starts, ends, np.searchsorted(starts, bounds[1:]), hashes, raw,
                 bounds)
