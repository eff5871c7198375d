"""Mixing sources to target weights by a multivariate-hypergeometric
splitting tree.

Targets: each source gets a share of the whole mix by its weight, but at most
``max_repeats`` times its size; what is over is shared again by weight until no
source is above.  A target of r sizes means floor(r) whole copies of the source
and the rest from a random order of its documents, the last document cut where
the target ends.

Draw: the documents of each source, in that order, form blocks of about
``block_words`` words.  The blocks of all sources are an urn; halving the
output shards again and again, each half takes a multivariate-hypergeometric
share of every source's blocks, which fixes exact quotas for each shard.  A
source's blocks are permuted (an affine map modulo their number) and dealt to
the shards by these quotas, so shards draw disjoint blocks; within a shard the
documents are shuffled by a hash.

Bounds: the driver holds one row a source (size, target, blocks) and the
quotas, sources x shards numbers.  Running sums are taken in cells of a hash
range of a source, so a source that holds most rows is spread over many tasks.

Edge cases: a null source is a source of its own, the last; null and empty
texts have size 0 and are taken with 0 words; repeated rows are documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.tables import WORD, keep


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (3, 1, 2)   # of the sources in order, repeating
    share: float = 1.5                       # words of the mix over words of all sources
    max_repeats: int = 2
    shards: int = 16
    block_words: int = 10_000
    cell_rows: int = 5_000
    seed: int = 7


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], p: Params) -> list[float]:
    """Words that the mix takes of each source, for (source, size) in order."""
    weight = [p.weights[i % len(p.weights)] for i in range(len(sizes))]
    left = p.share * sum(n for _, n in sizes)
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] >= p.max_repeats * sizes[i][1]}
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = float(p.max_repeats * sizes[i][1])
            left -= out[i]
        free -= full
    return out


def share(own: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of ``n`` blocks drawn without replacement are of each source of
    an urn (multivariate hypergeometric), whatever the urn's size.  Each block
    is taken with probability n / all; of so many taken every set is as likely,
    so what lacks is drawn from the rest, or what is over from the taken ones,
    in the same way: about the square root of ``n``.  The last few are drawn
    one by one."""
    taken, rest = np.zeros_like(own), own.copy()
    while n > 32:
        some = draw.binomial(rest, n / int(rest.sum()))
        over = int(some.sum()) - n
        if over > 0:
            some = some - share(some, over, draw)
        taken, rest, n = taken + some, rest - some, max(0, -over)
    for _ in range(n):
        i = int(np.searchsorted(np.cumsum(rest), draw.integers(int(rest.sum())), side="right"))
        taken[i] += 1
        rest[i] -= 1
    return taken


def quotas(blocks: list[int], p: Params) -> np.ndarray:
    """Blocks of each source for each shard: an array (shards, sources)."""
    draw = np.random.Generator(np.random.PCG64(p.seed))

    def split(own: np.ndarray, shards: int) -> list[np.ndarray]:
        if shards == 1:
            return [own]
        left = shards // 2
        part = share(own, int(own.sum()) * left // shards, draw)
        return split(part, left) + split(own - part, shards - left)

    return np.array(split(np.array(blocks, np.int64), p.shards), np.int64).reshape(p.shards, len(blocks))


def _step(n: int, seed: int) -> int:
    """A multiplier prime to n, about n times the golden ratio where its
    products with 0..n stay in 64 bits, else as large as they let it be."""
    a = max(1, min(int(n * 0.6180339887) + seed % max(1, n // 8 + 1), (1 << 62) // n))
    while math.gcd(a, n) != 1:
        a += 1
    return a


DRAWN = ("size", "source_size", "target", "taken", "copies", "partial", "shards", "order")


def draw(docs: DataFrame, p: Params = Params(), carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text and the columns of ``carry``):
    ``size``, ``source_size``, ``target``, ``taken`` words, ``copies`` (whole
    ones), ``partial`` (words of one more, cut or whole, copy) and ``shards``
    (the output shard of each copy, the partial one last).  ``prefix`` goes
    before these names, where ``carry`` has one of them."""
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}  # so that no input name clashes with a working name
    rows = keep(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"),
                            *[F.col(c).alias(n) for c, n in names.items()]), "mixing-rows")
    summary = sorted(((r["source"], r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()),
                     key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))  # a row a source
    goal = targets([r[:2] for r in summary], p)
    plan, urns = [], []
    for i, ((source, size, n), t) in enumerate(zip(summary, goal)):
        whole = min(p.max_repeats, round(t) // size) if size else 0
        rest = round(t) - whole * size if size else 0
        own = [max(1, -(-size // p.block_words))] * whole + [-(-rest // p.block_words)] * (rest > 0)
        urns += own
        plan.append((source, i, size, t, whole, rest, max(1, -(-n // p.cell_rows)), own))
    ends = np.cumsum(quotas(urns, p), axis=0).T.tolist()  # of each urn: its blocks in shards up to 0, 1, ...
    table = [(*row, [_step(u, p.seed) for u in row[-1]], [ends.pop(0) for _ in row[-1]]) for row in plan]
    plans = F.broadcast(docs.sparkSession.createDataFrame(table, "of string, number int, source_size long, target double, copies int, rest long, cells long, "
                                                          "urns array<long>, steps array<long>, ends array<array<long>>"))
    marked = (rows.join(plans, rows["source"].eqNullSafe(plans["of"])).withColumn("order", F.xxhash64(F.lit(p.seed), "doc_id", "size", "tie"))
              .withColumn("high", F.shiftrightunsigned("order", 32))
              .withColumn("cell", F.shiftright(F.col("high") * F.col("cells"), 32)))
    sums = marked.groupBy("number", "cell").agg(F.sum("size").alias("n"))  # a row for each `cell_rows` documents
    start = sums.select("number", "cell", F.coalesce(F.sum("n").over(W.partitionBy("number").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = W.partitionBy("number", "cell").orderBy("high", "order", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = (marked.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(start, ["number", "cell"]).withColumn("before", F.col("inside") + F.col("start")))
    partial = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long")
    copies = F.when(partial > 0, F.col("copies") + 1).otherwise(F.when(F.col("size") > 0, F.col("copies")).otherwise(0))

    def shard_of(copy: Column) -> Column:
        urn = F.element_at("urns", copy)
        block = F.least(F.floor(F.col("before") / p.block_words), urn - 1)
        at = F.pmod(block * F.element_at("steps", copy) + F.col("number"), urn)
        return F.size(F.filter(F.element_at("ends", copy), lambda x: x <= at))

    shards = F.when(copies > 0, F.transform(F.sequence(F.lit(1), copies), shard_of)).otherwise(F.array().cast("array<int>"))
    found = [F.col("size"), F.col("source_size"), F.col("target"), F.col("copies") * F.col("size") + partial, F.col("copies"), partial, shards, F.col("order")]
    return placed.select("doc_id", "source", *[c.alias(prefix + n) for c, n in zip(found, DRAWN)],
                         *[F.col(n).alias(c) for c, n in names.items() if c not in ("doc_id", "source")])


def write_order(drawn: DataFrame, p: Params = Params(), prefix: str = "") -> DataFrame:
    """A row for each copy that the mix takes: the columns of ``drawn`` with
    ``copy``, ``words`` (of it), ``shard`` and ``place`` (the order of the rows
    inside their shard)."""
    def c(name: str) -> Column:
        return F.col(prefix + name)

    rows = drawn.select("*", F.posexplode(c("shards")).alias(f"{prefix}copy", f"{prefix}shard"))
    return (rows.withColumn(f"{prefix}words", F.when(c("copy") < c("copies"), c("size")).otherwise(c("partial")))
            .withColumn(f"{prefix}place", F.xxhash64(F.lit(p.seed), c("shard"), c("copy"), c("order"))))


def cut(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")
