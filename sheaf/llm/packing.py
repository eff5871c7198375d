"""Best-fit packing of tokenised documents into sequences.

A document is its token ids and one closing id; only documents longer than a
sequence are cut.  Packing is hierarchical: pieces are dealt evenly to groups,
each group packs its own by best fit (longest first), and its nearly full bins
are sequences.  Underfull bins become items: groups are merged ``fan_in`` at a
time and their bins packed by best fit again, up to one root.

After best fit a group has at most one bin that is half full or less, and two
bins over half never fit together, so what a merge can still gain is a partner
for the few emptiest bins.  A group hands up its ``carry`` emptiest bins at
most and the rest are sequences as they are, which bounds every merge.

Edge cases: null and empty texts are pieces of the closing id alone; repeated
rows are packed as often as they occur; a null doc_id is kept; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.tables import keep

CAPACITY = 4096
END = 1


# between an ASCII letter and an ASCII mark or digit
_SEAM = re.compile(rb"(?<=[a-z])(?=[!-@\[-`{-~])|(?<=[!-@\[-`{-~])(?=[a-z])")


def fragments(found: list[bytes]) -> list[list[bytes]]:
    """Parts of words that the vocabulary's pre-tokenizer never joins, ASCII
    letters in lower case.  A word with an apostrophe (contractions) or with the
    beginning of a special token is left whole."""
    # words hold no white space: a line each, a vertical tab at each seam
    rows = _SEAM.sub(b"\x0b", b"\n".join(found).lower()).split(b"\n") if found else []
    return [[w] if b"'" in w or b"<|" in w else r.split(b"\x0b") for w, r in zip(found, rows)]


class Pool:
    """Runs of ids, by number."""

    def __init__(self) -> None:
        self.starts, self.ids, self.count = np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        used = int(self.starts[self.count])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        while self.count + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(sizes), len(self.starts)), np.int64)])
        self.ids[used:used + len(flat)] = flat
        self.starts[self.count + 1:self.count + len(sizes) + 1] = used + np.cumsum(sizes)
        self.count += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes of the runs ``at``, their ids one after another)."""
        start, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        return n, self.ids[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Token ids of words; each distinct word is put together from its
    fragments once, each distinct fragment encoded once, while it is kept.

    The vocabulary lower-cases, drops white space and joins nothing across it,
    so a text's ids are those of its words in turn."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.encoded: dict[bytes, int] = {}
        self.parts, self.words = Pool(), Pool()
        self.at: dict[int, int] = {}
        self.again = np.zeros(1024, bool)  # whether a second block had the word

    def _clear(self) -> None:
        """Forgets the words that only one block has had: most distinct words
        never come again."""
        kept = [(h, i) for h, i in self.at.items() if self.again[i]]
        if 2 * len(kept) > self.most:
            kept = []
        at, words_ = np.array([i for _, i in kept], np.int64), Pool()
        words_.add(*self.words.take(at))
        self.at, self.words = dict(zip([h for h, _ in kept], range(len(kept)))), words_
        self.again = np.zeros(1024, bool)

    def _encode(self, new: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([f.decode("utf-8", "replace") for f in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.encoded.update(zip(new, range(self.parts.count, self.parts.count + len(new))))
        self.parts.add(sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _add(self, hashes: list[int], found: list[bytes]) -> None:
        if not found:
            return
        parts = fragments(found)
        flat = list(chain.from_iterable(parts))
        new = list({f for f in flat if f not in self.encoded})
        if len(self.encoded) + len(new) > self.most:
            self.encoded.clear()
            self.parts = Pool()
            new = list(set(flat))
        self._encode(new)
        sizes, ids = self.parts.take(np.fromiter(map(self.encoded.__getitem__, flat), np.int64, len(flat)))
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        self.at.update(zip(hashes, range(self.words.count, self.words.count + len(found))))
        self.words.add(np.add.reduceat(sizes, np.cumsum(count) - count), ids)

    def block(self, b: words.Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of a block, bounds of its rows in them)."""
        if not len(b.starts):
            return np.empty(0, np.uint32), np.zeros(b.n_rows + 1, np.int64)
        unique, first, back = np.unique(b.hashes(), return_index=True, return_inverse=True)
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if self.words.count + len(new) > self.most:
            self._clear()
            new = [i for i, k in enumerate(keys) if k not in self.at]
        before = self.words.count
        raw, starts, ends = b.data.tobytes(), b.starts[first].tolist(), b.ends[first].tolist()
        self._add([keys[i] for i in new], [raw[starts[i]:ends[i]] for i in new])
        slot = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        while self.words.count > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(len(self.again), bool)])
        self.again[slot[slot < before]] = True
        n, ids = self.words.take(slot[back])
        return ids, np.append(0, np.cumsum(n))[b.bounds]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task."""
    return WordIds(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text) in tokens of the
    vocabulary at ``path``: ids are not kept, their number and crc32 are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            out = []
            for b in words.blocks(batch["text"]):
                ids, bounds = encode.block(b)
                for i in range(b.n_rows):
                    own = np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at:at + capacity]
                        out.append((doc_ids[b.first + i], k, at, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first into the fullest bin that
    still holds it.  ``open_`` has a bit for each free space that some bin has."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            own = free[space].pop()
            if not free[space]:
                open_ ^= 1 << space
        else:
            space, own, count = capacity, count, count + 1
        bins[i], offsets[i] = own, capacity - space
        if space > n:
            free[space - n].append(own)
            open_ |= 1 << (space - n)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = 20_000, fan_in: int = 8, carry: int = 2_500, slack: int = 4) -> DataFrame:
    """``pieces`` with the sequence of each and its place there:
    (``sequence_id``, ``offset``)."""
    rows = keep(pieces.withColumn("item", F.monotonically_increasing_id()), "packing-pieces")
    groups = -(-rows.count() // group_rows)

    def merge(level: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("item")
            bins, offsets = best_fit(frame["length"].to_numpy(), capacity)
            fill = np.bincount(bins, frame["length"])
            group = int(frame["group"].iloc[0])
            up = np.zeros(len(fill), bool)
            emptiest = np.argsort(fill, kind="stable")[:carry]
            up[emptiest] = fill[emptiest] < capacity - slack
            base = (level << 56) | (group << 24)
            return pd.DataFrame({"item": frame["item"], "bin": base + bins, "at": offsets, "fill": fill[bins].astype(np.int64), "up": up[bins]})
        return run

    put = "item long, bin long, at long, fill long, up boolean"
    dealt = rows.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(max(1, groups))).alias("group"))
    placed = keep(dealt.groupBy("group").applyInPandas(merge(0), put), "packing-0")
    # a bin's number holds its group, so the next level's group follows from it
    result = placed.select("item", "bin", "at")
    left, level, groups = placed.where("up").select("bin", "fill").distinct(), 1, max(1, groups)
    while groups > 1:
        groups = -(-groups // fan_in)
        of = F.floor(F.shiftrightunsigned(F.col("bin").bitwiseAND((1 << 56) - 1), 24) / fan_in).cast("long")
        merged = keep(left.select(F.col("bin").alias("item"), F.col("fill").alias("length"), of.alias("group"))
                      .groupBy("group").applyInPandas(merge(level), put), f"packing-{level}")
        moved = merged.select(F.col("item").alias("bin"), F.col("bin").alias("into"), F.col("at").alias("shift"))
        result = (result.join(moved, "bin", "left")
                  .select("item", F.coalesce("into", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at")))
        left, level = merged.where("up").select("bin", "fill").distinct(), level + 1
    return rows.join(result, "item").select(*pieces.columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
