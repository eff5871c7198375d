"""Document fingerprints by SimHash, and permuted block tables that find all
fingerprints within a Hamming radius.

Terms are the runs of ``gram`` lower-cased words of a text (the whole sequence
where there are fewer), weighted by 1 + ln(occurrences).  The 128 bits of each
term's hash vote with its weight; a bit of the fingerprint is 1 where the sum
is positive.  Texts without words have the fingerprint 0.

Search: the bits are cut into blocks, and a table for each block holds the
fingerprints permuted: rotated so that the block comes first, and keyed by it.
With ``radius`` = blocks * q + a, fingerprints within the radius differ in at
most q bits in one of the first a + 1 blocks or in at most q - 1 in one of the
others, so a query asks each table for its own block with up to that many bits
flipped, and the distance follows.  A pair counts in the first block that finds
it.  Equal fingerprints are one class first.  The result is the same for any
number of blocks; fewer and wider ones ask for more keys and meet fewer rows,
so their number follows the row count (``block_count``).

Edge cases: nulls are empty texts; equal texts have equal fingerprints;
``edited`` has a row for each input row: rows that share a doc_id follow one
another in order of their text, and a null doc_id comes last.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.tables import parts

BITS = 128
GRAM = 2
RADIUS = 14  # one to three words replaced in some hundred; see the README for the measured recall
MIN_BLOCKS = 3  # a key of 43 bits; wider ones have too many flips to list
_SECOND = np.uint64(0xA24BAED4963EE407)


def fingerprint(h: np.ndarray, gram: int = GRAM) -> bytes:
    """The 16 bytes of a text's fingerprint, from its word hashes."""
    terms = words.windows(h, gram)
    if not len(terms):
        return bytes(BITS // 8)
    terms, n = np.unique(terms, return_counts=True)
    lanes = np.stack([terms, words.mix(terms ^ _SECOND)], 1).astype(">u8").view(np.uint8)
    votes = (1 + np.log(n)).astype(np.float32) @ (np.unpackbits(lanes, axis=1).astype(np.float32) - np.float32(0.5))
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 - Hamming distance / bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprints(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc_id, fingerprint as hex) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in words.blocks(batch["text"]):
                h = b.hashes(lower=True)
                out += [fingerprint(h[s], gram).hex() for _, s in b.rows()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(doc_id: int | None, text: str, own: bytes, following: str, other: bytes, gram: int) -> tuple:
    raw = _edit(text, following).encode()
    new = fingerprint(words.block_of(raw).hashes(lower=True), gram)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, other)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
                                      names=[x.split()[0] for x in EDITED.split(", ")])


def _ranges(docs: DataFrame) -> tuple[np.ndarray, dict[int, int], dict[int, int]]:
    """(bounds of the id ranges, first id of each range, the range before it).

    All have one entry a range at most; ranges count from the highest ids."""
    n = parts(docs.sparkSession)
    keys = docs.select(_key().alias("key"))
    bounds = np.unique(np.array(keys.approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [], np.float64)).astype(np.int64)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch["key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_range_of(key, bounds)), pa.array(key)], names=["part", "key"])

    first = {r["part"]: r["first"] for r in keys.mapInArrow(firsts, "part long, key long").groupBy("part").agg(F.max("key").alias("first")).collect()}
    ring = sorted(first)
    return bounds, first, {k: ring[i - 1] for i, k in enumerate(ring)}


def _key():
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _range_of(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return len(bounds) - np.searchsorted(bounds, key, side="left")


def edited(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """Per row: its fingerprint, that of the text whose last half is replaced
    by the beginning of the next document (descending doc_id, after the last
    the first), and the likeness of its fingerprint to that and to the next.

    The texts are dealt once, to ranges of doc_id.  The first rows of a range
    also go to the range before it, marked as its tail, so that a task can
    walk its sorted rows with one text at hand beside the Arrow batch."""
    bounds, first, before = _ranges(docs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_, firsts = np.array(sorted(first), np.int64), np.array([first[k] for k in sorted(first)], np.int64)
        back = np.array([before[k] for k in sorted(first)], np.int64)
        for batch in batches:
            key = batch["key"].to_numpy()
            part = _range_of(key, bounds)
            slot = np.searchsorted(parts_, part)
            heads = np.flatnonzero(firsts[slot] == key)
            for rows, part, tail in ((batch, part, False), (batch.take(pa.array(heads)), back[slot[heads]], True)):
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([tail] * rows.num_rows, pa.bool_()), rows["key"], rows["doc_id"], rows["text"]],
                                                 names=["part", "tail", "key", "doc_id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, closed = None, set()
        for batch in batches:
            out = []
            for part, tail, doc_id, text in zip(batch["part"].to_pylist(), batch["tail"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                if part in closed:
                    continue
                text = text.as_py() or ""
                own = fingerprint(words.block_of(text.encode()).hashes(lower=True), gram)
                if last is not None:
                    out.append(_compare(*last, text, own, gram))
                last = None if tail else (doc_id, text, own)
                if tail:
                    closed.add(part)
            yield _rows(out)

    n = parts(docs.sparkSession)
    return (docs.select(_key().alias("key"), "doc_id", "text")
            .mapInArrow(deal, "part long, tail boolean, key long, doc_id long, text string")
            .repartitionByRange(n, "part").sortWithinPartitions("part", "tail", F.col("key").desc(), F.col("text").desc_nulls_last())
            .mapInArrow(walk, EDITED))


def _flips(bits: int, most: int) -> list[int]:
    """Masks of up to ``most`` of ``bits`` bits."""
    return [sum(1 << b for b in at) for n in range(most + 1) for at in itertools.combinations(range(bits), n)]


def layout(blocks: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, flips to ask for) of each block that needs a table."""
    q, a = divmod(radius, blocks)
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(start, end - start, q if i <= a else q - 1) for i, (start, end) in enumerate(zip(ends, ends[1:]))]
    return [c for c in cut if c[2] >= 0]


def block_count(rows: int, radius: int = RADIUS) -> int:
    """The number of blocks with the least work a query: the keys it asks for
    and, of so many rows with uniform bits, those that it meets."""
    def work(blocks: int) -> float:
        return sum(sum(math.comb(bits, n) for n in range(flips + 1)) * (1 + rows / 2 ** bits) for _, bits, flips in layout(blocks, radius))
    return min(range(MIN_BLOCKS, BITS // 8 + 1), key=work)


def _rotated(high: Column, low: Column, by: int) -> tuple[Column, Column]:
    """Both halves of a print rotated left by so many bits."""
    by %= BITS
    if by >= 64:
        high, low, by = low, high, by - 64
    if not by:
        return high, low
    return (F.shiftleft(high, by).bitwiseOR(F.shiftrightunsigned(low, 64 - by)),
            F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(high, 64 - by)))


def _permuted(prints: DataFrame, cut: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """(block, key, high, low, *more): each print once a table, its block first."""
    half = [F.shiftleft(F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("long"), 32)
            .bitwiseOR(F.conv(F.substring("fingerprint", at + 8, 8), 16, 10).cast("long")) for at in (1, 17)]
    rows = []
    for i, (start, bits, _) in enumerate(cut):
        high, low = _rotated(F.col("h"), F.col("l"), start)
        rows.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(high, 64 - bits).alias("key"), high.alias("high"), low.alias("low")))
    return (prints.select("fingerprint", half[0].alias("h"), half[1].alias("l"), *more)
            .select("fingerprint", F.explode(F.array(*rows)).alias("t"), *more).select("fingerprint", "t.*", *more))


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_near): for each row of ``queries`` (doc_id, fingerprint) the
    number of rows of ``prints`` within the radius, its own copies included.
    ``blocks``: 3 to 16; None for as many as suit the number of rows."""
    cut = layout(blocks or block_count(prints.count(), radius), radius)
    masks = [(i, m) for i, (_, bits, flips) in enumerate(cut) for m in _flips(bits, flips)]  # by radius and blocks alone
    flipped = queries.sparkSession.createDataFrame(pa.table({"block": pa.array([i for i, _ in masks], pa.int32()), "mask": pa.array([m for _, m in masks], pa.int64())}))
    table = _permuted(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), cut, "n").drop("fingerprint")
    asked = (_permuted(queries.select("fingerprint").distinct(), cut).join(F.broadcast(flipped), "block")
             .select("block", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "fingerprint", F.col("high").alias("own_high"), F.col("low").alias("own_low")))
    met = (asked.join(table, ["block", "key"])
           .select("fingerprint", "n", "block", F.col("own_high").bitwiseXOR(F.col("high")).alias("high"), F.col("own_low").bitwiseXOR(F.col("low")).alias("low"))
           .where(F.bit_count("high") + F.bit_count("low") <= radius))
    found = met.where(~F.coalesce(*[F.when(F.col("block") == i, _found_before(cut, i)) for i in range(len(cut))]))
    return queries.select("doc_id", "fingerprint").join(found.groupBy("fingerprint").agg(F.sum("n").alias("n_near")), "fingerprint").select("doc_id", "n_near")


def _found_before(cut: list[tuple[int, int, int]], i: int) -> Column:
    """Whether a table before the ``i``-th finds a pair whose prints, rotated
    to block ``i``, differ in the bits (high, low)."""
    out = F.lit(False)
    for start, bits, flips in cut[:i]:
        front, _ = _rotated(F.col("high"), F.col("low"), start - cut[i][0])
        out = out | (F.bit_count(F.shiftrightunsigned(front, 64 - bits)) <= flips)
    return out
