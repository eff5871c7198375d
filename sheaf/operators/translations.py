"""Piecewise translations of 0..limit: what a run of files does to a quota.

A file of p pages turns ``used`` into ``used + p`` where that is at most the
limit and leaves it otherwise, so a run of files is a map of 0..limit into
itself that is a translation on each of some intervals.  Small files fill a
quota to the same end from many starts, so an interval may also have one value.
A map is three arrays: the sorted first points of the intervals (``breaks``,
from 0), and ``slopes`` and ``shifts``, its value at u being slope * u + shift;
intervals that meet with one law are one.  Size and time follow the intervals,
not the limit.  Maps of neighbouring runs are composed pair by pair, all pairs
of a level at once: map number k has its intervals at ``k * width`` on one
line, ``width`` being limit + 1.

The intervals of a map are at most ``limit + 1`` and, where page counts repeat,
of the order of the run's files.  Page counts are not negative.
"""

from __future__ import annotations

import numpy as np

Map = tuple[np.ndarray, np.ndarray, np.ndarray]


def identity() -> Map:
    return np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64)


def _pairs(breaks: np.ndarray, slopes: np.ndarray, shifts: np.ndarray, n: int, width: int) -> Map:
    """The maps 0 and 1, 2 and 3, ... of a line composed; ``n`` is even."""
    number = breaks // width
    ends = np.append(breaks[1:], n * width)
    f = np.flatnonzero(number % 2 == 0)
    low, slope, shift, line = breaks[f] - number[f] * width, slopes[f], shifts[f], (number[f] + 1) * width
    begin = line + slope * low + shift  # images, on the line of the map that follows
    last = np.where(slope == 1, begin + ends[f] - breaks[f] - 1, begin)
    first = np.searchsorted(breaks, begin, side="right") - 1
    count = np.searchsorted(breaks, last, side="right") - first
    own = np.repeat(np.arange(len(f)), count)
    g = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    inside = np.maximum(breaks[g] - begin[own], 0)  # how far into its interval a piece begins
    at = low[own] + inside
    to = slopes[g] * slope[own], slopes[g] * shift[own] + shifts[g]
    return _joined(at + (number[f][own] // 2) * width, *to, n // 2, width)


def _joined(breaks: np.ndarray, slopes: np.ndarray, shifts: np.ndarray, n: int, width: int) -> Map:
    """Intervals that meet with one law as one; one of a single point has one value."""
    single = np.diff(np.append(breaks, n * width)) == 1
    shifts = np.where(single, slopes * (breaks % width) + shifts, shifts)
    slopes = np.where(single, 0, slopes)
    new = np.append(True, (np.diff(slopes) != 0) | (np.diff(shifts) != 0) | (np.diff(breaks // width) != 0))
    return breaks[new], slopes[new], shifts[new]


def compose(maps: list[Map], limit: int) -> Map:
    """The maps one after the other, the first one first."""
    width, most = limit + 1, max(2, (1 << 62) // (limit + 1))
    while len(maps) > most:  # a line of so many maps fits 64 bits
        maps = [compose(maps[i:i + most], limit) for i in range(0, len(maps), most)]
    if not maps:
        return identity()
    breaks = np.concatenate([f[0] + k * width for k, f in enumerate(maps)])
    return _reduced(breaks, np.concatenate([f[1] for f in maps]), np.concatenate([f[2] for f in maps]), len(maps), width)


def _reduced(breaks: np.ndarray, slopes: np.ndarray, shifts: np.ndarray, n: int, width: int) -> Map:
    while n > 1:
        if n % 2:
            breaks, slopes, shifts, n = np.append(breaks, n * width), np.append(slopes, 1), np.append(shifts, 0), n + 1
        breaks, slopes, shifts = _pairs(breaks, slopes, shifts, n, width)
        n //= 2
    return breaks, slopes, shifts


def of_files(pages: np.ndarray, limit: int) -> Map:
    """The map of files in order."""
    pages = pages[(pages > 0) & (pages <= limit)].astype(np.int64)  # others change nothing
    width, most = limit + 1, max(2, (1 << 62) // (limit + 1))
    maps = []
    for i in range(0, len(pages), most):
        own = pages[i:i + most]
        at = np.arange(len(own)) * width
        breaks = np.stack([at, at + width - own], axis=1).ravel()
        maps.append(_reduced(breaks, np.ones(len(breaks), np.int64), np.stack([own, np.zeros_like(own)], axis=1).ravel(), len(own), width))
    return maps[0] if len(maps) == 1 else compose(maps, limit)


def value(f: Map, used: int) -> int:
    i = np.searchsorted(f[0], used, side="right") - 1
    return int(f[1][i]) * used + int(f[2][i])


def replay(pages: np.ndarray, used: int, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(used before each file, whether it is admitted, used after all): runs of
    admitted files by running sums, up to the first that does not fit."""
    n, i = len(pages), 0
    admitted = np.zeros(n, bool)
    start = used
    while i < n:
        small = i + np.flatnonzero(pages[i:] <= limit - used)
        sums = used + np.cumsum(pages[small])
        fit = int(np.searchsorted(sums, limit, side="right"))
        admitted[small[:fit]] = True
        used = int(sums[fit - 1]) if fit else used
        i = int(small[fit]) + 1 if fit < len(small) else n
    before = start + np.cumsum(np.where(admitted, pages, 0)) - np.where(admitted, pages, 0)
    return before, admitted, used
