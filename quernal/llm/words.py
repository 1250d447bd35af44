"""Vectorised word handling on Arrow string buffers: no Python loop over rows or words.

A block is a run of rows whose UTF-8 bytes lie together. Words are found by a table of 256 byte values that
maps separators to 0 and other bytes to themselves or to lower case; a word's hash is a polynomial over its
folded bytes modulo 2**64, so one pass of `np.add.reduceat` hashes all the words of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
BLOCK = 1 << 20

SPACE = np.arange(256, dtype=np.uint8)
SPACE[[0, 9, 10, 11, 12, 13, 32]] = 0
FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128:
        FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        FOLD[_b] = _b
LINE = np.arange(256, dtype=np.uint8)
LINE[10] = 0

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. at least n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close values end far apart."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@dataclass
class Block:
    """Rows first .. first+n-1 of a batch. data: their bytes; offsets: n+1 positions in data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """The rows of a string column in blocks of about `size` bytes, a longer text alone. A null is like ''."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield from _of_array(part.cast(pa.large_binary()) if not pa.types.is_large_binary(part.type) else part, size)


def _of_array(part: pa.Array, size: int) -> Iterator[Block]:
    if part.null_count:
        part = part.fill_null(b"")
    _, offs, data = part.buffers()
    n = len(part)
    if not n:
        return
    off = np.frombuffer(offs, dtype=np.int64)[part.offset : part.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield Block(a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


@dataclass
class Words:
    """start, end: byte positions of each word; hash: of its folded bytes; first: n+1 word positions of the rows."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def fold(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes through `table`; with FOLD also the capitals among U+00C0..U+00DE become small letters."""
    if table is FOLD and len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        if len(at):
            data = data.copy()
            data[at] += 0x20
    return table[data]


def _single(data: np.ndarray) -> np.ndarray:
    """Where letters of scripts that put no space between words begin: U+3000..U+9FFF (kana, Han) and U+0E00..U+0EFF (Thai, Lao)."""
    at = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    thai = np.flatnonzero(data[:-1] == 0xE0)
    return np.concatenate([at, thai[(data[thai + 1] >= 0xB8) & (data[thai + 1] <= 0xBB)]])


def words(block: Block, table: np.ndarray = FOLD) -> Words:
    """Maximal runs of bytes that `table` doesn't map to 0; the ends of rows end words too. With FOLD a letter of a script without spaces is a word."""
    f = fold(block.data, table)
    n = len(f)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(len(block) + 1, np.int64))
    inside = f != 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    if table is FOLD:
        single = _single(block.data)
        edge[single] = True
        edge[np.minimum(single + 3, n)] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if len(start):
        byte = _BYTE.copy()
        byte[0] = 0
        vals = byte[f] * powers(_BASE, n)[:n]
        h = mix(np.add.reduceat(vals, start) * powers(_INV, n)[start])
    else:
        h = np.zeros(0, np.uint64)
    return Words(start, end, h, np.searchsorted(start, block.offsets))


_GRAM, _GRAM_INV = 0xF1357AEA2E62A9C5, pow(0xF1357AEA2E62A9C5, -1, 2**64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of the n words from each position; len(h)-n+1 of them, across row ends too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_GRAM, len(h))[: len(h)], out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * powers(_GRAM_INV, m)[:m])


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions of grams() lie within one row."""
    m = int(first[-1]) - n + 1
    ok = np.zeros(max(m, 0), dtype=bool)
    if m > 0:
        left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
        ok[:] = left >= n
    return ok


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` (one a word) over each row."""
    c = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]


def chars(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between byte positions."""
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c[end] - c[start]
