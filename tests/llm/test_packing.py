import random
import zlib

import numpy as np
import pytest

from sheaf.llm import packing, queries
from tests.llm.helpers import SF

PATH = queries.tokenizers_path("word_bpe_49k.json")


def model(rows, capacity):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out += [(i, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity", [4096, 50])
def test_pieces_are_the_tokenizers_ids(odd, small, capacity):
    for docs in (odd, small):
        got = sorted((tuple(r) for r in packing.pieces(docs, PATH, capacity).collect()), key=repr)
        assert got == model([(r["doc_id"], r["text"]) for r in docs.collect()], capacity)


def test_odd_words(spark):
    texts = ["<|endoftext|> a<|startoftext|>b", "é ́ ＡＢ ﬁ  x y İ ΑΣ ς", "don't I'LL 12345 a_b--c\x1cd\x85e", "﻿zero​width 가각 नमस्ते",
             "THE,END é,x a–,b DON'T x'S,Y <|ENDOFTEXT|> <|endoftext|>,X A\u0301B,C ±x½y²z x_y-z9a 3rd,4th ...A..b K\u212aK, ÀB!!C ß.s ﬁ,N"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((tuple(r) for r in packing.pieces(docs, PATH).collect()), key=repr) == model(list(enumerate(texts)), 4096)


def test_word_cache_may_be_cleared():
    from sheaf.llm import words
    whole, tiny = packing.WordIds(PATH), packing.WordIds(PATH, most=3)
    for text in (b"a b c d e f g a b", b"x y", b"a a a"):
        b = words.block_of(text)
        assert whole.block(b)[0].tolist() == tiny.block(b)[0].tolist()


def test_best_fit_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(30):
        lengths = np.array([rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))])
        bins, offsets = packing.best_fit(lengths, 100)
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(100 - n)
        fill = np.bincount(bins, lengths)
        assert sorted(100 - fill) == sorted(free)
        for b in range(len(fill)):
            own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()


def sequences(rows, capacity):
    own = {}
    for r in rows:
        own.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in own.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= capacity
    return len(own)


def test_tree_of_groups(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.choice([3, 10, 30, 45, 60, 90, 100]), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    got = packing.pack(pieces, 100, group_rows=100, fan_in=3, slack=0).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    one = len(set(packing.best_fit(np.array([r[3] for r in rows]), 100)[0].tolist()))
    assert sequences(got, 100) <= one * 1.03 + 1
    few = packing.pack(pieces, 100, group_rows=100, fan_in=3, carry=4).collect()
    assert sequences(few, 100) <= one * 1.1 + 1


def test_odd_rows_and_query(spark, odd, empty):
    got = packing.pack(packing.pieces(odd, PATH)).collect()
    assert len(got) == len(model([(r["doc_id"], r["text"]) for r in odd.collect()], 4096))
    sequences(got, 4096)
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
    whole = queries.QUERIES["op6_best_fit_packing"](spark, SF).collect()
    assert sequences(whole, 4096) <= sum(r["length"] for r in whole) / 4096 * 1.03 + 1
