"""Counting quotient filters over keys of two halves of ``width`` bits.

A key is permuted invertibly (a Feistel network over its halves), so that keys
fall evenly whatever they mean, and then divided: its upper bits are the
quotient, a place in the filter, and all its other bits the remainder, which is
stored in full.  A filter therefore has no false positives, and its keys can be
read back.  In memory it is the sorted permuted keys with their counts; packed,
a quotient costs one bit and an entry one more for the length of its run, the
remainder's bytes, and one byte of counter, which continues in eight where it
is full.  Filters are cut by their first bits into shards, and filters of the
same shard are merged by their sorted order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from sheaf.llm.words import mix

_ROUNDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(4)]
FULL = 255  # a counter that continues


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _turn(half: np.ndarray, k: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(half + _ROUNDS[k]) & _mask(width)


def permute(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    for k in range(len(_ROUNDS)):
        left, right = right, left ^ _turn(right, k, width)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    for k in range(len(_ROUNDS) - 1, -1, -1):
        left, right = right ^ _turn(left, k, width), left
    return left, right


def _bytes(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each number, in whole bytes, plane by plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].T).tobytes()


def _numbers(raw: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :-(-bits // 8)] = np.frombuffer(raw, np.uint8).reshape(-(-bits // 8), n).T
    return out.view("<u8").ravel().astype(np.uint64)


@dataclass(frozen=True)
class Filter:
    width: int
    left: np.ndarray     # permuted, sorted by (left, right), distinct
    right: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(left: np.ndarray, right: np.ndarray, width: int) -> Filter:
        """Counts of the keys (left, right), each said once or more."""
        left, right = permute(left.astype(np.uint64), right.astype(np.uint64), width)
        if 2 * width <= 64:
            key = np.sort(left << np.uint64(width) | right)
            left, right = key >> np.uint64(width), key & _mask(width)
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
        first = np.flatnonzero(_starts(left, right))
        return Filter(width, left[first], right[first], np.diff(first, append=len(left)).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.left)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return restore(self.left, self.right, self.width)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of keys that the filter holds (halves of 32 bits at most)."""
        left, right = permute(left.astype(np.uint64), right.astype(np.uint64), self.width)
        w = np.uint64(self.width)
        return np.searchsorted(self.left << w | self.right, left << w | right)

    def shards(self, top: int) -> Iterator[tuple[int, Filter]]:
        """The filter cut by the first ``top`` bits; shards without a key are left out."""
        own = (self.left >> np.uint64(self.width - top)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
            yield int(own[a]), Filter(self.width, self.left[a:b], self.right[a:b], self.count[a:b])

    def packed(self, top: int) -> bytes:
        """One shard's bytes: what its number, the first ``top`` bits, leaves out."""
        n, w = len(self), self.width
        q = min(w - top, max(0, n - 1).bit_length())
        inner = self.left & _mask(w - top)
        rest = w - top - q
        runs = np.bincount((inner >> np.uint64(rest)).astype(np.int64), minlength=1 << q)
        bits = np.ones(n + len(runs), np.uint8)
        bits[np.cumsum(runs + 1) - 1] = 0  # a run of ones a quotient
        long_ = self.count >= FULL
        return b"".join([struct.pack("<QBQ", n, q, int(long_.sum())), np.packbits(bits).tobytes(), _bytes(inner & _mask(rest), rest), _bytes(self.right, w),
                         np.minimum(self.count, np.uint64(FULL)).astype(np.uint8).tobytes(), self.count[long_].astype("<u8").tobytes()])

    @staticmethod
    def unpacked(raw: bytes, shard: int, top: int, width: int) -> Filter:
        n, q, longs = struct.unpack_from("<QBQ", raw)
        at, view = struct.calcsize("<QBQ"), memoryview(raw)
        rest = width - top - q

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size:at]

        bits = np.unpackbits(np.frombuffer(take(-(-(n + (1 << q)) // 8)), np.uint8), count=n + (1 << q))
        runs = np.diff(np.flatnonzero(bits == 0), prepend=-1) - 1
        left = np.repeat(np.arange(1 << q, dtype=np.uint64), runs) << np.uint64(rest) | _numbers(take(n * -(-rest // 8)), n, rest)
        left |= np.uint64(shard << (width - top))
        right = _numbers(take(n * -(-width // 8)), n, width)
        count = np.frombuffer(take(n), np.uint8).astype(np.uint64)
        count[count == FULL] = np.frombuffer(take(8 * longs), "<u8")
        return Filter(width, left, right, count)


def _starts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted ones."""
    return np.concatenate([np.ones(min(1, len(left)), bool), (left[1:] != left[:-1]) | (right[1:] != right[:-1])])


def merge(filters: list[Filter]) -> tuple[Filter, list[np.ndarray]]:
    """(the sum of the filters, for each filter the places of its keys in it)."""
    width = filters[0].width
    left, right, count = (np.concatenate([getattr(f, c) for f in filters]) for c in ("left", "right", "count"))
    if 2 * width <= 64:
        order = np.argsort(left << np.uint64(width) | right, kind="stable")
    else:
        order = np.lexsort((right, left))
    starts = _starts(left[order], right[order])
    first = np.flatnonzero(starts)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(starts) - 1
    total = np.add.reduceat(count[order], first) if len(first) else count
    return (Filter(width, left[order][first], right[order][first], total),
            np.split(place, np.cumsum([len(f) for f in filters])[:-1]))
