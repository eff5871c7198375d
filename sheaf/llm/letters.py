"""Words of letters of whole texts, as numpy arrays of lower-case code points.

A word is a run of letters and combining marks (Unicode categories L and M) with
a letter in it, in pieces of at most ``LONGEST`` code points, so that scripts
without spaces and encoded binaries give bounded words too.  Texts are taken a
slice of about ``SLICE`` code points at a time, cut where a word ends; a longer
text is several slices.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sheaf.llm.words import mix

LONGEST = 40
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    """2 for a letter, 1 for a mark, 0 for others, by code point."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


@dataclass
class Slice:
    rows: np.ndarray     # the row of the batch of each word
    codes: np.ndarray    # lower-case code points
    starts: np.ndarray
    ends: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans(self.codes, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.codes[self.starts[i]:self.ends[i]].tobytes().decode("utf-32-le")


def spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points [start, end) of at most
    ``LONGEST`` + 2."""
    size = ends - starts
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int(size.max(initial=0))):
            own = np.flatnonzero(size > j)
            h[own] = h[own] * _BASE + codes[starts[own] + j].astype(np.uint64) + np.uint64(1)
        return mix(mix(h) + size.astype(np.uint64))


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Slices as lists of (row, text or part of one)."""
    out, size = [], 0
    for row, text in enumerate(texts):
        text, begin = (text or "").lower(), 0
        if out and len(text) > SLICE:
            yield out
            out, size = [], 0
        while len(text) - begin > SLICE:
            gaps = np.flatnonzero(_kinds()[_codes(text[begin:begin + SLICE])] == 0)
            # no gap: the words of this run are pieces of LONGEST from its start
            end = begin + (int(gaps[-1]) + 1 if len(gaps) else SLICE // LONGEST * LONGEST)
            yield [(row, text[begin:end])]
            begin = end
        text = text[begin:]
        if size + len(text) > SLICE:
            yield out
            out, size = [], 0
        out.append((row, text))
        size += len(text) + 1
    if out:
        yield out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(texts: pa.Array) -> Iterator[Slice]:
    for own in _pieces(texts.to_pylist()):
        codes = _codes("\n".join(t for _, t in own))
        kinds = _kinds()[codes]
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = kinds > 0
        starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        if len(starts) and int((ends - starts).max()) > LONGEST:
            n = -(-(ends - starts) // LONGEST)
            first = np.repeat(starts, n) + LONGEST * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            starts, ends = first, np.minimum(first + LONGEST, np.repeat(ends, n))
        letters = np.concatenate([[0], np.cumsum(kinds == 2)])
        some = letters[ends] > letters[starts]
        starts, ends = starts[some], ends[some]
        begins = np.cumsum([0, *[len(t) + 1 for _, t in own[:-1]]])
        rows = np.array([r for r, _ in own])[np.searchsorted(begins, starts, side="right") - 1] if len(starts) else np.empty(0, np.int64)
        yield Slice(rows, codes, starts, ends)


def grams(s: Slice, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index into ``words``) of the runs of ``n`` code points of these
    words of a slice, a space before and after each word."""
    size = s.ends[words] - s.starts[words] + 2
    ends = np.cumsum(size)
    padded = np.full(int(ends[-1]) if len(ends) else 0, ord(" "), np.uint32)
    own = np.repeat(np.arange(len(words)), size - 2)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    padded[(ends - size)[own] + 1 + at] = s.codes[s.starts[words][own] + at]
    count = np.maximum(size - n + 1, 0)
    word = np.repeat(np.arange(len(words)), count)
    first = (ends - size)[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    return spans(padded, first, first + n), word


def table_of(found: list[str]) -> Slice:
    """Words that are already single, as a slice."""
    size = np.array([len(w) for w in found], np.int64)
    codes = _codes("".join(found))
    ends = np.cumsum(size)
    return Slice(np.arange(len(found)), codes, ends - size, ends)
