"""Sharding by minimax contiguous partition, with DataFrame operations only.

Rows of equal text are an atomic group, and groups are ordered by the SHA-256
of their text.  The largest shard is as small as an ordered cut into at most
``shards`` runs allows: a binary search finds the smallest capacity that a
greedy walk over the groups can keep to, and the cuts are made there.

The walk needs no list of all groups.  The driver holds sums of groups by a
prefix of the SHA-256 (``16 ** digits`` sums at most).  Sums taken as atomic
bound the capacity from above, the mean and the largest group from below; only
prefixes that a cut may fall into between these bounds are read again by a
longer prefix, until no cut can fall inside one.

Edge cases: a null text is a group of its own (size 1, crc32 of no bytes);
an empty text another (size 1); repeated rows are rows of one group, and get
slots of their own; a group larger than the mean has the shard it needs; an
empty table gives no rows; fewer groups than shards leave the last shards
empty."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheaf.llm.tables import keep


@dataclass(frozen=True)
class Run:
    """Neighbouring groups whose keys begin with ``prefix``."""

    prefix: str
    size: int
    groups: int


def _walk(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where shards end, as indices of the prefix sums ``sums`` (sums[0] = 0);
    None where the capacity is too small."""
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        ends.append(at)
    return ends if at == len(sums) - 1 else None


def _smallest(sums: list[int], low: int, shards: int) -> int:
    """The smallest capacity, ``low`` at least, that the walk keeps to."""
    high = max(sums[-1], low)
    while low < high:
        mid = (low + high) // 2
        if _walk(sums, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def _open(runs: list[Run], sums: list[int], low: int, high: int, shards: int) -> set[int]:
    """Runs of several groups that a cut may fall into, whatever the capacity
    from ``low`` to ``high``: every shard's end lies from the run that holds the
    earliest possible end to the one that holds the latest."""
    out: set[int] = set()
    first = last = 0
    for _ in range(shards - 1):
        i = bisect_right(sums, first + low) - 1
        first = sums[i]
        j = bisect_right(sums, last + high) - 1
        last = sums[j] if j >= len(runs) or runs[j].groups == 1 else last + high
        out |= {k for k in range(i, min(j + 1, len(runs))) if runs[k].groups > 1}
    return out


def cut_keys(groups: DataFrame, shards: int, digits: int = 3) -> list[str]:
    """The first keys of shards 1, 2, ... from a table (key, size) of groups."""
    def read(n: int, within: list[str]) -> list[Run]:
        rows = groups.where(F.substring("key", 1, len(within[0])).isin(within)) if within else groups
        # 16 ** digits rows, later those of the few prefixes that a cut may fall into
        return [Run(r["prefix"], r["size"], r["groups"]) for r in
                rows.groupBy(F.substring("key", 1, n).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups")).collect()]

    runs, largest = read(digits, []), groups.agg(F.max("size")).first()[0]
    while runs:
        runs.sort(key=lambda r: r.prefix)
        sums = list(accumulate((r.size for r in runs), initial=0))
        low = max(largest, -(-sums[-1] // shards))
        high = _smallest(sums, low, shards)
        again = _open(runs, sums, low, high, shards)
        if not again:
            return [runs[e].prefix for e in _walk(sums, high, shards)[:-1] if e < len(runs)]
        found = [r for k, r in enumerate(runs) if k not in again]
        for n in {len(runs[k].prefix) for k in again}:
            found += read(n + 3, [runs[k].prefix for k in again if len(runs[k].prefix) == n])
        runs = found
    return []


def shard(docs: DataFrame, shards: int = 16, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs``
    (doc_id, text): size is the UTF-8 bytes of the text plus 1.

    Slots number the rows of a shard without a gap.  They are dealt in buckets
    by a hash of the row, so that neither a large shard nor a large group is
    numbered by one task."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                            F.when(F.col("text").isNull(), "-").otherwise(F.sha2(text, 256)).alias("key")), "sharding-rows")
    groups = keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "sharding-groups")
    cuts = cut_keys(groups, shards)
    buckets = 1 + rows.count() // bucket_rows
    number = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    dealt = rows.withColumn("shard", number).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # shards * buckets rows, a row for 20 000 documents
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "key")
    return (dealt.withColumn("place", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")))
