import random

import numpy as np
import pytest

from sheaf.llm import neardup
from sheaf.llm.components import components
from tests.llm.helpers import roots, shingles


def expected(rows, percent):
    """doc_id -> smallest doc_id reachable, for rows (doc_id, text) of known ids."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    links = []
    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                links.append((i, j))
    return roots(links, {i for i, _ in rows})


@pytest.mark.parametrize("p", [neardup.Params(), neardup.Params(percent=80, rows=4, bands=32)])
def test_against_brute_force(spark, small, p):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = expected(rows, p.percent)
    got = neardup.near_duplicates(small, p).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    texts = dict(rows)
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_edits_that_no_star_links(spark):
    """Many edited copies of one text, most of them too far from each other."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}" if rng.random() < 0.7 else "same"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(80))) for i in range(1, 30)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == expected(rows, 85)


def test_odd_rows(spark, odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    one = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] != 5}
    assert one[1]["component_id"] == 1 and one[1]["n_shingles"] == 0 and one[2]["kept"] and one[3]["kept"]
    assert one[8]["component_id"] == 7 and one[10]["component_id"] == 9 and not one[10]["kept"]
    assert one[12]["component_id"] == 11 and one[13]["component_id"] == 11
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.near_duplicates(empty).count() == 0


def test_band_agreement_follows_similarity():
    """Densified bins of short sets still agree at about the rate of the similarity."""
    rng, p = np.random.default_rng(1), neardup.Params()
    for size in (8, 40, 400):
        same = []
        for _ in range(200):
            a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(size * 0.92)], rng.integers(0, 2 ** 63, size - int(size * 0.92), dtype=np.uint64)]))
            similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same.append((neardup.signature(a, 125) == neardup.signature(b, 125)).mean() - similarity)
        assert abs(np.mean(same)) < 0.05
    assert len(neardup.signature(np.array([5], np.uint64), 125)) == 125


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5)]
    want = roots(edges, {x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


