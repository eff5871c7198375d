"""Words of whole texts as numpy arrays, a block of rows at a time.

A word is a run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  Those bytes
never occur inside a multi-byte UTF-8 character, so words of bytes are the
words of code points.  Nulls count as empty texts.  A block holds whole texts,
about ``BLOCK_BYTES`` of them (one longer text is a block of its own), which
bounds what a task keeps beside its Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.ones(256, bool)   # separators that leave runs of letters and non-ASCII characters
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in, uint64 out)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(steps)
    return _POWERS


@dataclass
class Block:
    """Words of rows ``first .. first + n_rows - 1`` of an Arrow batch."""

    first: int
    n_rows: int
    data: np.ndarray      # UTF-8 bytes of the block
    offsets: np.ndarray   # n_rows + 1 byte offsets into data
    starts: np.ndarray    # byte offset of each word
    ends: np.ndarray      # byte offset after each word
    bounds: np.ndarray    # n_rows + 1 word offsets: the words of row i
    inside: np.ndarray    # whether a byte belongs to a word

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        data = _LOWER[self.data] if lower else self.data
        at = np.zeros(len(data), np.int64)
        at[self.starts] = self.starts
        at = np.arange(len(data)) - np.maximum.accumulate(at)
        with np.errstate(over="ignore"):
            value = _BYTE[data]
            value[~self.inside] = 0
            at[~self.inside] = 0
            value *= _powers(int(at.max()) + 1)[at]
            total = np.add.reduceat(value, self.starts)
            return mix(total + (self.ends - self.starts).astype(np.uint64))

    def rows(self) -> Iterator[tuple[int, slice]]:
        """(row of the batch, its words)."""
        for i in range(self.n_rows):
            yield self.first + i, slice(self.bounds[i], self.bounds[i + 1])

    def text(self, i: int) -> bytes:
        """UTF-8 bytes of row ``first + i``."""
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; nulls as empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at.astype(np.int64)


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES, separators: np.ndarray = _SPACE) -> Iterator[Block]:
    """The rows of a string column, block by block; ``separators`` marks the
    bytes that no word holds."""
    data, offsets = bytes_of(texts)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        own = offsets[first:last + 1] - offsets[first]
        yield _split(first, data[offsets[first]:offsets[last]], own, separators)
        first = last


def block_of(text: bytes, separators: np.ndarray = _SPACE) -> Block:
    """The words of one text."""
    return _split(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]), separators)


def _split(first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Block:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]                       # a text's end also ends its last word
    at = cuts[(cuts > 0) & (cuts < n)]
    begins[at] = inside[1:-1][at]
    ends[at - 1] = inside[1:-1][at - 1]
    starts = np.flatnonzero(begins)
    return Block(first, len(offsets) - 1, data, offsets, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets), inside[1:-1])


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; one of the whole sequence where there
    are fewer (none of no words)."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    total = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * np.uint64(_BASE) + hashes[j:n - k + 1 + j]
        return mix(total + np.uint64(k))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
