import math
import re
from collections import Counter

import numpy as np
import pytest

from sheaf.llm import quality, queries, words
from tests.llm.helpers import SF, split


def base(text):
    w = split(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed)


def columns(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


def test_base_counts_of_odd_rows(spark, odd):
    trusted = spark.createDataFrame([(5,), (5,), (None,), (9,), (18,), (17,)], "doc_id long")
    got = quality.rate(odd, trusted).collect()
    want = Counter((r["doc_id"], *base(r["text"])) for r in odd.collect())
    assert Counter((r["doc_id"], *columns(r)) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_empty_table_and_no_trusted_text(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.rate(empty, none).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.rate(odd, none).collect())


def test_scores_against_brute_force(spark, small):
    p = quality.Params()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r["doc_id"]: r["text"] for r in small.collect()}
    import zlib
    trusted = {i for i, q in labels.items() if q == 1}
    fitted = {i for i in trusted if zlib.crc32(str(i).encode()) % p.held_out != p.held_out - 1}
    cells = {}
    for i, t in rows.items():
        h = words.block_of((t or "").encode()).hashes(lower=True)
        cells[i] = (np.concatenate([h, words.windows(h, 2)] if len(h) > 1 else [h]) % np.uint64(p.buckets)).astype(np.int64)
    raw, target = np.full(p.buckets, p.alpha), np.full(p.buckets, p.alpha)
    for i, c in cells.items():
        np.add.at(raw, c, 1)
        if i in fitted:
            np.add.at(target, c, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    score = {i: float(ratio[c].mean()) if len(c) else 0.0 for i, c in cells.items()}
    held = sorted(math.floor(round(score[i], 9) / p.step) for i in trusted - fitted if i in rows)
    limit = held[len(held) - math.ceil(p.keep_trusted * len(held) - 1e-9)] * p.step
    got = queries.QUERIES["op1_quality_rules"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-8)
        assert columns(r) == base(rows[r["doc_id"]])
        if abs(r["score"] - limit) > 1e-7:
            assert r["kept"] == (not r["base_failed"] and r["score"] >= limit)


def test_junk_is_told_from_trusted_prose(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {(r["quality"], r["kept"]): r["count"] for r in queries.QUERIES["op1_quality_rules"](spark, sf).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert got[1, True] > 0.95 * (got[1, True] + got.get((1, False), 0))
    assert got[0, False] > 0.3 * (got[0, False] + got.get((0, True), 0))
