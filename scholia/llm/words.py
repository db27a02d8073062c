"""Vectorised word scanning over Arrow string columns, used inside tasks.

Texts are handled in pieces of about `CHUNK` bytes (always whole texts), so that memory stays bounded by the longest
text. A word is a maximal run of bytes other than ASCII white space and punctuation; ASCII and Latin-1 capitals are
folded. Words are identified by a 64-bit hash of their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BREAK = SPACE.copy()
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        BREAK[_c] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: hash, index of the text (within the batch), first and end byte within its text."""

    first_text: int
    n_texts: int
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def bounds(self) -> np.ndarray:
        """For each text of this piece, where its words begin in `hash`; one more entry for the end."""
        return np.searchsorted(self.text, np.arange(self.first_text, self.first_text + self.n_texts + 1))

    def index(self) -> np.ndarray:
        """Position of each word within its text."""
        return np.arange(len(self.text)) - self.bounds()[self.text - self.first_text]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def scan(column: pa.Array, breaks: np.ndarray = BREAK) -> Iterator[Words]:
    """Words of every text of the column, in pieces of whole texts."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield _scan(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, breaks)
        at = to


def _scan(data: np.ndarray, offsets: np.ndarray, first: int, breaks: np.ndarray) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(n + 2, dtype=bool)  # a text begins at this byte
    edge[offsets + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
    low = LOWER[data]
    if n > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return Words(first, len(offsets) - 1, hashes, text + first, starts - offsets[text], ends - offsets[text], data, offsets)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over `a`."""
    if not a or not b:
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()
