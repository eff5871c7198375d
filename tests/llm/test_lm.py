import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import lm, queries
from tests.llm.helpers import SF, lower_words


def token_lists(rows):
    return [(i, train, [*lower_words(text), None]) for i, text, train in rows]


def base(rows):
    """Per row (n_tokens, n_known, base score), and N, by the definition."""
    rows = token_lists(rows)
    c = Counter(w for _, train, t in rows if train for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, len(t), sum(c[w] > 0 for w in t), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, _, t in rows], n


def interpolated(rows, weights):
    """Model scores by plain counts and given weights of frequency buckets."""
    rows = token_lists(rows)
    uni, bi = Counter(), Counter()
    for _, train, t in rows:
        if train:
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, _, t in rows:
        total = 0.0
        for h, w in zip([None, *t[:-1]], t):
            b = int(math.log2(uni[h])) + 1 if uni[h] else 0
            l2, l1, l0 = weights[min(b, len(weights) - 1)]
            rest = l1 * uni[w] / max(1, n) + l0 / (v + 1)
            total += math.log10(l2 * bi[h, w] / uni[h] + rest if uni[h] else rest / (1 - l2))
        out.append((i, total))
    return out


def check(docs, p):
    rows = [(r["doc_id"], r["text"], r["train"]) for r in docs.collect()]
    want, n = base(rows)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["train_tokens"]) for r in lm.score_corpus(docs, p).collect()))
    assert got == sorted((i is None, i or 0, t, k, round(b, 6), n) for i, t, k, b in want)


@pytest.mark.parametrize("chunk_bytes", [1, 3000, 8 << 20])
def test_base_score_of_odd_rows(odd, chunk_bytes):
    docs = odd.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(1)) % 4 != 0).alias("train"))
    check(docs, lm.Params(chunk_bytes=chunk_bytes, min_buckets=3))


def test_edges(odd, empty):
    assert lm.score_corpus(empty.select("doc_id", "text", F.lit(True).alias("train"))).count() == 0
    none = odd.select("doc_id", "text", F.lit(False).alias("train"))
    check(none, lm.Params())
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) and r["score"] <= 0 for r in lm.score_corpus(none).collect())


def test_model_score_against_brute_force(spark, small, monkeypatch):
    learned = []
    real = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: learned.append(real(*a)) or learned[-1])
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_deleted_interpolation"](spark, SF).collect()}
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in small.collect()]
    m = learned[0]
    assert np.allclose(m.weights.sum(axis=1), 1) and m.tokens == base(rows)[1]
    for i, want in interpolated(rows, m.weights.tolist()):
        assert got[i]["score"] == pytest.approx(want, rel=1e-9)
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _, train in rows if not train}
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.3 * sum(r["n_tokens"] for r in held)


def test_weights_by_plain_expectation_maximisation(spark, small):
    """Held-out counts: each token from counts without its own document."""
    p = lm.Params(rounds=40)
    docs = small.select("doc_id", "text", F.lit(True).alias("train"))
    packed = lm.keep(lm.chunks(docs, p), "t")
    cells = lm.statistics(lm.counted(packed, lm.answers(lm.requests(packed, 5))), p).toPandas()
    m = lm.learn(*(cells[c].to_numpy() for c in ("bucket", "bigram", "unigram", "n", "types")), p)
    rows = token_lists([(r["doc_id"], r["text"], True) for r in docs.collect()])
    uni, bi, own = Counter(), Counter(), []
    for _, _, t in rows:
        u, b = Counter(t), Counter(zip([None, *t[:-1]], t))
        own.append((u, b))
        uni.update(u)
        bi.update(b)
    n, v = sum(uni.values()), len(uni)
    assert (m.tokens, m.types) == (n, v)
    estimates = defaultdict(list)
    for (_, _, t), (u, b) in zip(rows, own):
        for h, w in zip([None, *t[:-1]], t):
            context = uni[h] - u[h]
            estimates[int(math.log2(context)) + 1 if context else 0].append(((bi[h, w] - b[h, w]) / context if context else 0, (uni[w] - u[w]) / n, 1 / (v + 1)))
    for bucket, e in estimates.items():
        e, weights = np.array(e), np.full(3, 1 / 3)
        for _ in range(p.rounds):
            share = weights * e
            share = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + p.prior / 3
            weights = share / share.sum()
        assert np.abs(m.weights[bucket] - weights).max() < 0.03


def test_pack_round_trip():
    for x in ([], [0], [2 ** 64 - 1, 3, 0], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(x, np.uint64))).tolist() == x
