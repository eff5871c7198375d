import math
from fractions import Fraction

import numpy as np
import pytest

from sheaf.llm import queries, whitening
from tests.llm.helpers import SF

P = whitening.Params()


def whole(vectors, scale=64, offset=1_000_000):
    """x of the vectors that stay, None for the others."""
    out = []
    for v in vectors:
        ok = v is not None and all(c is not None and math.isfinite(c) for c in v)
        out.append([math.floor(scale * float(c)) + offset for c in v] if ok else None)
    return out


def brute(x):
    """(deviations, covariance) in exact arithmetic."""
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    v = [[float(sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in x) / n) for j in range(len(sums))] for i in range(len(sums))]
    return deviation, np.array(v), np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])


def against_brute(rows, got):
    """``rows``: (vec_id, vector), ids distinct."""
    kept = [(i, x) for (i, _), x in zip(rows, whole([v for _, v in rows])) if x is not None]
    deviation, v, centred = brute([x for _, x in kept])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(32, int((values > 1e-11 * values[0]).sum()))
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert set(by) == {(i, c) for i, _ in kept for c in range(1, k + 1)} and len(by) == len(got)
    for (i, _), d in zip(kept, deviation):
        assert all(by[i, c]["deviation"] == d and by[i, c]["n"] == len(kept) for c in range(1, k + 1))
    white = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in kept])
    assert np.abs(white.T @ white / len(kept) - np.eye(k)).max() < 1e-6
    for c in range(k):
        assert by[kept[0][0], c + 1]["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-6)
        alone = min([abs(values[c] - values[o]) for o in range(len(values)) if o != c], default=1) > 1e-3 * values[0]
        if alone:
            want = centred @ vectors[c] / math.sqrt(values[c])
            assert np.abs(white[:, c] * np.sign(white[:, c] @ want) - want).max() < 1e-8 * max(1, np.abs(want).max())
    assert all(r["identity_error"] < 1e-6 for r in got)


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    against_brute(rows, whitening.components(table.repartition(3)).collect())
    got = queries.QUERIES["op12_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    all_ = got.collect()
    assert len(all_) == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert {r["identity_error"] for r in all_} == {all_[0]["identity_error"]} and all_[0]["identity_error"] < 1e-10


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-5, 6, 4) / 8]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, [0.125] * 4), (105, [0.125] * 4), (106, [-0.0, 1e-9, -1e-9, 3.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, dim int, c0 string").repartition(5)
    against_brute(rows, whitening.components(table).collect())


def test_short_and_empty_vectors_are_filled_up(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, []), (4, [0.0, -1.0]), (5, [2.0, 0.0, 1.0])]
    got = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    against_brute([(i, v + [0.0] * (3 - len(v))) for i, v in rows], got)


def test_no_variance_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, [])]):
        assert whitening.components(spark.createDataFrame(rows, kind)).collect() == []


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 1.0]), (2, [3.0, -1.0])]
    got = whitening.components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]


def test_entries_beyond_64_bit_products(spark):
    rows = [(i, [float(i) * 1e15, float(-i), 7.0]) for i in range(6)] + [(9, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.components(table).collect()
    held = [[max(-2**53, min(2**53, x)) for x in v] for v in whole([v for _, v in rows])]
    deviation = dict(zip([i for i, _ in rows], brute(held)[0]))
    assert got and all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 2**63 else None) for r in got)


@pytest.mark.parametrize("name", ["random", "identity", "diagonal", "low rank", "repeated values", "close pairs", "blocks", "one", "two", "zero"])
def test_eigen(name):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    low = rng.standard_normal((48, 5))
    x = rng.standard_normal((300, 48))
    pairs = np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    blocks = np.zeros((48, 48))
    blocks[:20, :20], blocks[20:, 20:] = np.eye(20) * 3, np.cov(x[:, 20:].T)
    a = {"random": x.T @ x, "identity": np.eye(48), "diagonal": np.diag(np.arange(48.0)), "low rank": low @ low.T, "close pairs": pairs, "blocks": blocks,
         "repeated values": q @ np.diag([1e6] + [5.0] * 30 + [1.0] * 17) @ q.T, "one": np.array([[4.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]), "zero": np.zeros((3, 3))}[name]
    values, vectors = whitening.eigen(a, 32)
    want = np.linalg.eigvalsh(a)[::-1][:32]
    scale = max(np.abs(want).max(), 1e-9)
    assert np.abs(values - want).max() < 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-13
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-13 * scale


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, e = rng.standard_normal(20), rng.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.standard_normal(50) * 2
    assert whitening.below(d, e, at).tolist() == [int((values < x).sum()) for x in at]
