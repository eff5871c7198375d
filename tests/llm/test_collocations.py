import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheaf.llm import collocations, queries
from sheaf.llm.collocations import Params
from sheaf.llm.quotient import Filter, merge, permute, restore
from tests.llm.helpers import SF


def brute(rows, p):
    """The result for rows (text, lang)."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= p.least}
        hidden = set()
        for g, a in candidates.items():
            hidden |= {g[i:i + n] for n in range(2, len(g)) for i in range(len(g) - n + 1) if 100 * a >= p.cover * f[g[i:i + n]]}
        found = []
        for g, a in candidates.items():
            if g not in hidden:
                score, k = min((p.scale * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(c for g, c in f.items() if len(g) == 1)
        out += [(lang, i + 1, t.decode(), -a, l, r, n, -s) for i, (s, a, t, l, r) in enumerate(sorted(found)[:p.top])]
    return sorted(out)


def result(df, p=Params()):
    got = collocations.collocations(df, p)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("p", [Params(), Params(least=3, chunk_bytes=20_000, held_chunks=2, shard_words=1000), Params(least=5, top=40, cover=50)])
def test_against_brute_force(spark, p):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").repartition(3)
    assert result(docs, p) == brute([tuple(r) for r in docs.collect()], p)


def test_odd_rows(spark, odd, empty):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    for least in (1, 2, 30):
        p = Params(least=least)
        assert result(odd, p) == brute(rows, p)
    assert result(empty) == []
    assert result(empty.unionByName(odd.where("text is null"))) == []
    assert result(odd.where("doc_id = 4"), Params(least=1)) == []  # one word


def test_pieces_words_and_ties(spark):
    rows = [("A b. a B; a\x0bb\ta  b\x0cb a,a b c a b É é", "x")] * 3 + [("a b", None), ("a b", "und"), ("", "x"), (" . ,", "y"), ("n n n n n n", "z"), ("b c d e. b c d e. b c d", "t"), ("d b c. d b c. b c", "t")]
    df = spark.createDataFrame(rows, "text string, lang string")
    for p in (Params(least=2), Params(least=1), Params(least=1, top=2), Params(least=2, cover=100)):
        assert result(df, p) == brute(rows, p)


def test_text_above_a_chunk(spark):
    rng = np.random.default_rng(4)
    text = " ".join(f"w{int(i)}" + (",", "")[int(k)] for i, k in zip(rng.zipf(1.4, 300_000) % 5000, rng.integers(0, 9, 300_000) > 0))
    assert len(text) > 1 << 20
    rows = [(text, "en"), ("w1 w2", "en"), (text[:5000], "fr")]
    p = Params(chunk_bytes=100_000)
    assert result(spark.createDataFrame(rows, "text string, lang string"), p) == brute(rows, p)


def test_products_beyond_64_bits(spark):
    """Scores of counts that no text reaches."""
    big = 9_000_000_000_000_000_000
    numbered = spark.createDataFrame([(1, big), (2, big - 1), (3, big // 3)], "id long, f long")
    phrases = spark.createDataFrame([(2, [1, 2], big // 2), (2, [2, 3], 7), (3, [1, 2, 3], 7), (2, [3, 3], big // 3)], "gram int, ids array<long>, f long")
    got = {tuple(r["ids"]): (r["a"], r["l"], r["r"], r["score"]) for r in collocations.scores(phrases, numbered, Params()).collect()}
    third = big // 3
    assert got == {(1, 2): (big // 2, big, big - 1, 2_000_000 * (big // 2) // (2 * big - 1)),
                   (1, 2, 3): (7, big, 7, 0),  # both cuts give 0, the first counts
                   (3, 3): (third, third, third, 1_000_000)}


@pytest.mark.parametrize("width", [1, 2, 7, 17, 32, 33, 48, 64])
def test_filters(width):
    rng = np.random.default_rng(width)
    high = (1 << width) - 1
    draw = lambda n: rng.integers(0, min(high, 40), n, endpoint=True).astype(np.uint64) * np.uint64(max(1, high // 41))
    left, right = draw(3000), draw(3000)
    a, b = permute(left, right, width)
    assert (np.array(restore(a, b, width)) == np.array([left, right])).all() and int(max(a.max(), b.max())) <= high
    for top in {0, 1, min(5, width)}:
        whole, parts = Counter(), defaultdict(list)
        for x, y in ((left[:100], right[:100]), (left, right), (left[:0], right[:0]), (np.repeat(left[:1], 300), np.repeat(right[:1], 300))):
            f = Filter.of(x, y, width)
            whole.update(zip(x.tolist(), y.tolist()))
            assert dict(zip(zip(*[k.tolist() for k in f.keys()]), f.count.tolist())) == Counter(zip(x.tolist(), y.tolist()))
            for shard, piece in f.shards(top):
                back = Filter.unpacked(piece.packed(top), shard, top, width)
                assert (back.left == piece.left).all() and (back.right == piece.right).all() and (back.count == piece.count).all()
                parts[shard].append(back)
        got = {}
        for own in parts.values():
            total, places = merge(own)
            for f, at in zip(own, places):
                assert (total.left[at] == f.left).all() and (total.right[at] == f.right).all()
            got |= dict(zip(zip(*[k.tolist() for k in total.keys()]), total.count.tolist()))
        assert got == whole


def test_packed_filter_is_small():
    rng = np.random.default_rng(0)
    f = Filter.of(rng.integers(0, 1 << 17, 200_000), rng.integers(0, 1 << 17, 200_000), 17)
    assert len(f.packed(4)) < 6 * len(f)


def test_query(spark):
    got = queries.QUERIES["op13_collocations"](spark, SF).collect()
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == brute(rows, Params())
