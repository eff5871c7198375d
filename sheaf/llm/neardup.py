"""Near-duplicates by MinHash: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

A document's set holds the hashes of its distinct shingles.  One permutation is
cut into ``rows * bands`` bins of equal range; a bin's value is the least hash
in it, and an empty bin takes the value of the first non-empty bin in a probe
sequence of its own (the same for all documents).  ``rows`` bins make a band,
equal bands a bucket.

1. Copies (equal sets) are one class, represented by its smallest doc_id.
2. In each bucket all members get an edge to one centre, the member whose
   buckets are largest: as many candidate edges as members.  They are confirmed
   on the full sets.
3. What is linked is joined to components.  In buckets that still hold several
   components, members of different ones may be linked by an edge that no star
   had.  Such a pair shares a rare shingle, or both sets consist mostly of
   frequent ones; the pairs that this exact condition allows are confirmed too.

So every pair that shares a bucket is confirmed, ruled out by a bound, or
already in one component.  A pair at the threshold misses all buckets with
probability (1 - s ** rows) ** bands: 4e-7 for 0.85, 5 and 25, and 5e-8 for
0.8, 4 and 32.

Edge cases: nulls and texts without words are empty sets, linked with nothing;
fewer words than a shingle are one shingle; repeated rows are copies; a null
doc_id stays out (component null, kept); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.components import components
from sheaf.llm.tables import drop, keep


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 85   # linked: 100 * intersection >= percent * union
    rows: int = 5
    bands: int = 25
    rare: int = 8       # a shingle is frequent if more sets have it

    @property
    def least(self) -> int:
        """Sets below this size are linked with equal sets only."""
        return -(-100 // (100 - self.percent)) - 1


def shingles(h: np.ndarray, p: Params) -> np.ndarray:
    """The set of a text with word hashes ``h``, sorted."""
    return np.unique(words.windows(h, p.shingle))


@lru_cache(4)
def _probes(bins: int, tries: int) -> np.ndarray:
    """Row t: for each bin the bin it looks at in try t."""
    at = np.arange(tries * bins, dtype=np.uint64) + np.uint64(1)
    return (words.mix(at * np.uint64(0x9FB21C651E98DF25)) % np.uint64(bins)).astype(np.int64).reshape(tries, bins)


def signature(found: np.ndarray, bins: int) -> np.ndarray:
    """The value of each bin for a non-empty sorted set."""
    mixed = np.sort(words.mix(found ^ np.uint64(0x51ED270B9F3A7C15)))
    own = ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    value, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    value[own[first]], filled[own[first]] = mixed[first], True
    empty, tries = np.flatnonzero(~filled), 16
    while len(empty):
        probes = _probes(bins, tries)[:, empty]
        hit = filled[probes]
        ok = hit.any(axis=0)
        value[empty[ok]] = value[probes[hit.argmax(axis=0), np.arange(len(empty))]][ok]
        empty, tries = empty[~ok], tries * 8
    return value


def band_keys(found: np.ndarray, p: Params) -> np.ndarray:
    value = signature(found, p.rows * p.bands).reshape(p.bands, p.rows)
    with np.errstate(over="ignore"):
        key = np.arange(p.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(p.rows):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + value[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for b in words.blocks(batch["text"]):
                h = b.hashes(lower=True)
                for _, s in b.rows():
                    found = shingles(h[s], p)
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
                    keys.append(band_keys(found, p) if len(found) >= p.least else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest string, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets pass the threshold; texts
    (node, text).  Sorted by a, each task builds the set of a centre once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            centres = batch["a"].to_pylist()
            for b in words.blocks(batch["text_b"]):
                h = b.hashes(lower=True)
                for i, s in b.rows():
                    if centres[i] != last or left is None:
                        last, left = centres[i], shingles(words.block_of((batch["text_a"][i].as_py() or "").encode()).hashes(lower=True), p)
                    right = shingles(h[s], p)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    linked[i] = both > 0 and 100 * both >= p.percent * (len(left) + len(right) - both)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    rows = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _rare(texts: DataFrame, p: Params) -> DataFrame:
    """(shingle, node, n): the shingles that n <= ``p.rare`` texts of the table
    have.  Counted first, so no frequent shingle is gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch["node"].to_numpy()
            for b in words.blocks(batch["text"]):
                h = b.hashes(lower=True)
                sets = [shingles(h[s], p) for _, s in b.rows()]
                yield pa.RecordBatch.from_arrays([words.as_long(np.concatenate(sets)), pa.array(np.repeat(node[b.first:b.first + b.n_rows], [len(x) for x in sets]))], names=["shingle", "node"])

    rows = texts.mapInArrow(run, "shingle long, node long").distinct()
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= p.rare)
    return rows.join(counts.hint("merge"), "shingle")


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): an edge from the centre of each bucket to each other member."""
    score = shared.groupBy("node").agg(F.sum("size").alias("score"))
    ranked = shared.join(score, "node")
    centre = ranked.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("a"))
    return ranked.join(centre, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _rest(shared: DataFrame, known: DataFrame, stars: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(a, b): pairs of two components in buckets that hold several, which no
    star had and which can reach the threshold.

    Of linked sets a and b, a has at most n(a) - o shingles that b has not,
    o being the least intersection.  So a has o shingles at least that are
    either frequent here or also in b: the pair shares a rare shingle, or both
    sets have o frequent ones.  Rare shingles give few pairs each; sets of
    mostly frequent shingles are compared bucket by bucket."""
    rooted = shared.where("size > 2").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = keep(rooted.join(mixed, "key").select("key", "node", "n", "root"), "neardup-mixed")
    nodes = left.select("node", "n", "root").distinct()
    rare = keep(_rare(texts.join(nodes.select("node"), "node"), p), "neardup-rare")

    x, y = F.col("x"), F.col("y")
    least = p.percent * (x["size"] + y["size"])  # of (100 + percent) * intersection
    owners = (rare.where("n > 1").select("shingle", "node").join(nodes.withColumnRenamed("n", "size"), "node")
              .groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("node", "size", "root"))).alias("own")))  # p.rare at most
    sharing = (owners.select("own", F.explode("own").alias("x"))
               .select("x", F.explode(F.filter("own", lambda o: (o["node"] > x["node"]) & (o["root"] != x["root"]))).alias("y"))
               .where((100 + p.percent) * F.least(x["size"], y["size"]) >= least)
               .select(x["node"].alias("a"), y["node"].alias("b")))

    few = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    # a pair comes once, from the least of the buckets that both are in
    buckets = left.groupBy("node").agg(F.collect_list("key").alias("keys"))
    able = (left.join(few, "node", "left").withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0)))
            # the smallest partner has percent / 100 of its shingles
            .where((100 + p.percent) * 100 * F.col("common") >= p.percent * (100 + p.percent) * F.col("n")))
    able = keep(able.join(buckets, "node"), "neardup-able")
    a, b = (able.select("key", *[F.col(c).alias(f"{c}_{z}") for c in ("node", "n", "root", "common", "keys")]) for z in "ab")
    allowed = ((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
               & ((100 + p.percent) * F.least("common_a", "common_b") >= p.percent * (F.col("n_a") + F.col("n_b")))
               & (F.array_min(F.array_intersect("keys_a", "keys_b")) == a["key"]))
    frequent = a.join(b, (a["key"] == b["key"]) & allowed).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return sharing.unionByName(frequent).distinct().join(done, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``
    (doc_id, text): kept is true for the smallest doc_id of a component."""
    rows = keep(signatures(docs, p), "neardup-signatures")
    own = rows.where("doc_id is not null and digest is not null")
    classes = keep(own.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "neardup-classes")
    members = classes.select("node", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keep(members.join(sizes, "key").select("key", "node", "n", "size"), "neardup-buckets")
    texts = keep(docs.select(F.col("doc_id").alias("node"), "text").join(shared.select("node").distinct().hint("merge"), "node"), "neardup-texts")

    stars = keep(_stars(shared), "neardup-stars")
    edges = keep(confirm(stars, texts, p), "neardup-links")
    known = keep(components(edges), "neardup-components")
    more = keep(confirm(_rest(shared, known, stars, texts, p), texts, p), "neardup-more")
    if not more.isEmpty():
        known = keep(components(edges.unionByName(more)), "neardup-components")
    drop(shared, texts, stars, edges, more)
    roots = classes.select("digest", "node").join(known, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    found = rows.join(roots, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return (found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
