import random
import zlib
from itertools import accumulate

import pytest

from sheaf.llm import queries, sharding
from tests.llm.helpers import SF


def smallest_capacity(sizes, shards):
    """By trying each capacity that a run of groups can have, on small lists."""
    def fits(capacity):
        used, now = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if now + s > capacity:
                used, now = used + 1, 0
            now += s
        return used <= shards
    low, high = max(sizes), sum(sizes)
    return next(c for c in range(low, high + 1) if fits(c))


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_cuts_are_minimax(spark, shards):
    rng = random.Random(shards)
    groups = sorted((f"{rng.getrandbits(256):064x}", rng.choice([1, 3, 8, 60])) for _ in range(300))
    want = smallest_capacity([s for _, s in groups], shards)
    for digits in (1, 3):
        cuts = sharding.cut_keys(spark.createDataFrame(groups, "key string, size long"), shards, digits)
        loads = [0] * shards
        for key, size in groups:
            loads[sum(key >= c for c in cuts)] += size
        assert max(loads) == want


def test_walk_and_open_runs():
    sums = list(accumulate([5, 5, 5, 5], initial=0))
    assert sharding._walk(sums, 10, 2) == [2, 4] and sharding._walk(sums, 9, 2) is None
    runs = [sharding.Run(str(i), 5, 9) for i in range(4)]
    assert sharding._open(runs, sums, 10, 12, 2) == {2}


def check(rows, docs, shards):
    rows = [r.asDict() for r in rows]
    sent = sorted((r["doc_id"] is None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in rows) == sent
    for k in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    assert all(0 <= r["shard"] < shards for r in rows)
    where = {}
    for r in rows:
        if r["size"] > 1:
            assert where.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]


def test_odd_rows(odd, empty):
    for shards in (1, 4, 16):
        check(sharding.shard(odd, shards).collect(), odd.collect(), shards)
    assert sharding.shard(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, 0)


def test_query(spark, small):
    got = queries.QUERIES["op8_minimax_shards"](spark, SF).collect()
    check(got, small.collect(), 16)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}


def test_a_group_that_holds_most_rows(spark):
    rows = [(i, "hot copy " * 20 if i % 3 else f"own text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(sharding.shard(docs, 16, bucket_rows=50).collect(), docs.collect(), 16)
