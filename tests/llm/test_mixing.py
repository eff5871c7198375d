import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheaf.llm import mixing, queries
from tests.llm.helpers import SF, split


def reshared(sizes, weights, share, most):
    """Targets, by moving the excess of sources above their limit until none is."""
    want, fixed = [0.0] * len(sizes), set()
    left = share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return want
        unit = left / sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if unit * weights[i % len(weights)] > most * sizes[i]]
        if not over:
            for i in free:
                want[i] = unit * weights[i % len(weights)]
            return want
        for i in over:
            want[i] = most * sizes[i]
            left -= want[i]
            fixed.add(i)


def test_targets():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 40, 1000, 30_000]) for _ in range(rng.randrange(1, 9))]
        got = mixing.targets([(str(i), n) for i, n in enumerate(sizes)], mixing.Params())
        assert got == pytest.approx(reshared(sizes, (3, 1, 2), 1.5, 2)) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_quotas_split_every_urn_exactly():
    p = mixing.Params(shards=13)
    blocks = [0, 1, 13, 500, 99]
    got = mixing.quotas(blocks, p)
    assert got.shape == (13, 5) and (got >= 0).all() and got.sum(axis=0).tolist() == blocks
    total = sum(blocks)
    assert all(abs(int(x) - total / 13) <= 4 for x in got.sum(axis=1))
    assert (mixing.quotas(blocks, p) == got).all()
    assert mixing.quotas([], p).shape == (13, 0) and mixing.quotas([2 * 10 ** 9, 7], p).sum() == 2 * 10 ** 9 + 7


def check(rows, docs, p=mixing.Params()):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(split(d["text"]))
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    want = dict(zip(order, reshared([sizes[s] for s in order], (3, 1, 2), 1.5, 2)))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) == -(-r["taken"] // r["size"] if r["size"] else 0)
        assert all(0 <= s < p.shards for s in r["shards"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in order)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], len(split(d["text"]))) for d in docs)


def test_odd_rows(odd, empty):
    check(mixing.draw(odd).collect(), odd.collect())
    assert mixing.draw(empty).count() == 0


def test_query_and_reruns(spark, small):
    first = mixing.draw(small).collect()
    check(first, small.collect())
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["shards"]) for r in rows)
    assert key(first) == key(mixing.draw(small.repartition(3)).collect()) == key(queries.QUERIES["op5_mixing"](spark, SF).collect())


def test_shards_keep_their_quotas_and_draw_disjoint_blocks(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(900)]
    p = mixing.Params(block_words=100, shards=8, cell_rows=70)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.write_order(mixing.draw(docs, p), p).collect()
    assert sum(r["words"] for r in got) == 13_500
    per = Counter(r["shard"] for r in got)
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 40
    assert all(n == 1 for n in Counter((r["doc_id"], r["copy"]) for r in got).values())


def test_cut_keeps_the_first_words(spark):
    rows = [(" a\tb  c\n", 2), ("a b", 5), ("", 1), ("x", 0)]
    got = spark.createDataFrame(rows, "t string, n long").select(mixing.cut(mixing.F.col("t"), mixing.F.col("n"))).collect()
    assert [r[0] for r in got] == [" a\tb", "a b", "", ""]


def test_multipliers_are_prime_to_the_number_of_blocks():
    assert all(np.gcd(mixing._step(n, 7), n) == 1 for n in range(1, 400))


def test_a_share_has_the_hypergeometric_law():
    draw = np.random.Generator(np.random.PCG64(1))
    own, n, times = np.array([60, 25, 0, 15]), 40, 6000  # above the few drawn one by one
    got = np.array([mixing.share(own, n, draw) for _ in range(times)])
    assert (got.sum(axis=1) == n).all() and (got >= 0).all() and (got <= own).all()
    for i, good in enumerate(own.tolist()):
        law = np.array([math.comb(good, k) * math.comb(100 - good, n - k) / math.comb(100, n) for k in range(n + 1)])
        seen = np.bincount(got[:, i], minlength=n + 1) / times
        assert np.abs(seen - law).max() < 5 * math.sqrt(0.25 / times)


@pytest.mark.parametrize("size", [10 ** 6, 10 ** 12, 10 ** 17])
def test_shares_of_urns_of_any_size(size):
    draw = np.random.Generator(np.random.PCG64(2))
    own = np.array([6, 3, 0, 1], np.int64) * (size // 10)
    n = size // 3
    got = np.array([mixing.share(own, n, draw) for _ in range(400)])
    assert (got.sum(axis=1) == n).all() and (got >= 0).all() and (got <= own).all()
    p = own / size
    spread = np.sqrt(n * p * (1 - p) * (size - n) / (size - 1))
    z = (got - n * p)[:, p > 0] / spread[p > 0]
    assert np.abs(z).max() < 5 and np.abs(z.mean(axis=0)).max() < 0.25 and np.abs(z.std(axis=0) - 1).max() < 0.15


def test_quotas_and_steps_of_very_many_blocks():
    p = mixing.Params()
    blocks = [10 ** 12, 3 * 10 ** 12 + 7, 5, 0]
    found = mixing.quotas(blocks, p)
    assert found.sum(axis=0).tolist() == blocks and np.ptp(found.sum(axis=1)) <= p.shards
    for n in [1, 2, 9, 10 ** 6, 10 ** 10, *blocks[:2]]:
        step = mixing._step(n, p.seed)
        assert math.gcd(step, n) == 1 and step * n < 2 ** 63
