import glob
import random
import tempfile
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import passages, queries, tables
from tests.llm.helpers import SF, lower_words


def say(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def covered(rows):
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    return got


def exact(texts, k):
    """doc_id -> words inside runs of k words that a document of smaller id has."""
    first, need = {}, defaultdict(set)
    for i in sorted(texts):
        w = lower_words(texts[i])
        for x in range(len(w) - k + 1):
            if first.setdefault(tuple(w[x:x + k]), i) != i:
                need[i].update(range(x, x + k))
    return need


def test_every_exact_repeat_of_real_texts_is_found(spark, small):
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    got, need = covered(queries.QUERIES["op10_shared_passages"](spark, SF).collect()), exact(texts, 50)
    assert need and all(words <= got[i] for i, words in need.items())


def test_planted_passages(spark):
    """Exact and edited passages of 51 to 120 words in texts of other words, one
    of them in most documents, one cut short in the first document that has it."""
    rng = random.Random(7)
    planted = [say(rng, n, 10 ** 6) for n in (51, 60, 90, 120)]
    rows, want, clean = [], [], []
    for i in range(120):
        w = say(rng, rng.randrange(40, 200), 10 ** 6)
        if i % 5 == 0:
            clean.append(i)
        else:
            own = list(planted[1 if i % 5 < 3 else rng.randrange(4)])
            if i == 1:
                own = own[:30]
            elif i % 7 == 0:
                for _ in range(len(own) // 20):
                    own[rng.randrange(len(own))] = f"edit{rng.randrange(10 ** 6)}"
            at = rng.randrange(len(w))
            w[at:at] = own
            want.append((i, at, len(own)))
        rows.append((i, " ".join(w)))
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found, seen = covered(got), set()
    for i, at, n in want[1:]:
        key = n
        if key in seen:   # all but the first document of a passage
            assert len(found[i] & set(range(at, at + n))) >= 0.8 * n, (i, n)
        seen.add(key)
        assert not found[i] or len(found[i] - set(range(at, at + n))) <= 5
    assert not any(found[i] for i in clean) and all(r["other_doc_id"] < r["doc_id"] for r in got)
    texts = {i: t.split() for i, t in rows}
    for r in got:
        a, b = texts[r["doc_id"]][r["start"]:r["end"]], texts[r["other_doc_id"]][r["other_start"]:r["other_end"]]
        assert len(a) >= 40 and r["matches"] >= 0.8 * max(len(a), len(b)) and a[0] == b[0] and a[-1] == b[-1]


def plain_chain(pos, other, p):
    best = []
    for i in range(len(pos)):
        gains = [best[j] - p.gap * (pos[i] - pos[j] + other[i] - other[j]) for j in range(i) if other[j] < other[i]]
        best.append(p.k + max([0.0, *gains]))
    return max(best)


def test_fenwick_chains_are_the_best(monkeypatch):
    rng, p = np.random.default_rng(3), passages.Params(min_anchors=1)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        pos, other = np.sort(rng.choice(300, n, replace=False)), rng.integers(0, 300, n)
        out = passages.chains(pos, other, p)
        assert sorted(np.concatenate(out).tolist()) == list(range(n))
        for c in out:
            assert (np.diff(pos[c]) > 0).all() and (np.diff(other[c]) > 0).all()
        c = out[0]
        score = p.k * len(c) - p.gap * (pos[c[-1]] - pos[c[0]] + other[c[-1]] - other[c[0]])
        assert score == pytest.approx(plain_chain(pos.tolist(), other.tolist(), p))


def test_seeds_meet_in_equal_runs():
    rng, p = np.random.default_rng(5), passages.Params()
    n = p.k + p.window - 1
    for _ in range(100):
        same = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2 ** 63, int(rng.integers(0, 40)), dtype=np.uint64), same, rng.integers(0, 2 ** 63, int(rng.integers(0, 40)), dtype=np.uint64)]) for _ in range(2))
        assert set(passages.seeds(a, p)[0].tolist()) & set(passages.seeds(b, p)[0].tolist())


def test_repeated_words_give_few_seeds_but_one_a_window():
    p = passages.Params()
    h = np.concatenate([np.arange(30, dtype=np.uint64) * 7919, np.full(1000, 5, np.uint64), np.arange(40, dtype=np.uint64) * 104729])
    found, at = passages.seeds(h, p)
    runs = passages.words.windows(h, p.k)
    assert (found == runs[at]).all() and len(at) < 120
    for i in range(len(runs) - p.window + 1):
        assert ((at >= i) & (at < i + p.window)).any()


def test_odd_rows(spark, odd, empty):
    long_, near = ([r["text"] for r in odd.where(f"doc_id = {i}").collect()][0] for i in (9, 11))
    got = passages.passages(odd).collect()
    found = covered(got)
    assert {9, 11} & set(found) == set() and all(len(found[i]) == n for i, n in ((10, len(lower_words(long_))), (12, len(lower_words(near)))))
    assert passages.passages(empty).count() == 0
    after = passages.cut(odd, passages.passages(odd))
    assert after.columns == odd.columns and after.count() == odd.count()
    texts = defaultdict(set)
    for r in after.collect():
        texts[r["doc_id"]].add(r["text"])
    assert texts[10] == {""} and texts[12] == {"more"} and texts[1] == {None} and "no id at all" in texts[None] and "another text of id five" in texts[5]
    assert passages.cut(empty, passages.passages(empty)).count() == 0


def test_cut_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, " a b\tc  d\n e é f "), (2, "x y"), (3, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 5, 6), (2, 0, 9), (3, 0, 1)], "doc_id long, start int, end int")
    got = {r["doc_id"]: r["text"] for r in passages.cut(docs, found).collect()}
    assert got == {1: " a d\n e f ", 2: "x y", 3: None}


def test_a_passage_in_most_documents(spark):
    rng = random.Random(9)
    shared = say(rng, 70, 10 ** 6)
    rows = [(i, " ".join([*say(rng, 20, 10 ** 6), *shared, *say(rng, 20, 10 ** 6)])) for i in range(300)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(i, 0) for i in range(1, 300)}
    assert all((r["start"], r["end"]) == (20, 90) for r in got)


def test_exact_passages_beside_frequent_lines():
    """Words that agree again after many that differ neither take an exact
    passage below the least identity nor own words into a passage."""
    rng, p = random.Random(11), passages.Params()
    for same in (50, 60, 100):
        for own, line, times in ((14, 4, 1), (14, 8, 1), (14, 8, 5), (16, 8, 3), (16, 4, 2)):
            for side in (False, True):
                shared, common = [rng.randrange(1, 2 ** 60) for _ in range(same)], [rng.randrange(1, 2 ** 60) for _ in range(line)]
                a, b = [], []
                for t in (a, b):
                    for _ in range(times):
                        t += [*[rng.randrange(1, 2 ** 60) for _ in range(own)], *common]
                a, b = ([*shared, *t] if side else [*t[own:], *t[:own], *shared] for t in (a, b))
                x = 5 if side else len(a) - same + 5
                at, to = np.array([x, x + 20]), np.array([x, x + 20])
                got = passages.align(np.array(a, np.uint64), np.array(b, np.uint64), at, to, p)
                start = 0 if side else len(a) - same
                assert got == [(start, start + same, start, start + same, same)], (same, own, line, times, side)


def test_a_stretch_of_too_few_matches_is_split():
    rng, p = random.Random(12), passages.Params()
    say_ = lambda n: [rng.randrange(1, 2 ** 60) for _ in range(n)]
    one, two, bits = say_(60), say_(45), [say_(7) for _ in range(12)]
    a = [*one, *[w for x in bits for w in (*say_(3), *x)], *say_(3), *two]
    b = [*one, *[w for x in bits for w in (*say_(3), *x)], *say_(3), *two]
    got = passages.align(np.array(a, np.uint64), np.array(b, np.uint64), np.array([0, 20, len(a) - 20]), np.array([0, 20, len(b) - 20]), p)
    words_ = {w for s, e, *_ in got for w in range(s, e)}
    assert set(range(60)) <= words_ and set(range(len(a) - 45, len(a))) <= words_
    assert all(n >= p.identity * max(e - s, oe - os) for s, e, os, oe, n in got)


def test_passages_of_a_repeated_line(spark):
    """A line said over and over, one word said sixty times."""
    rng, rows, want = random.Random(13), [], []
    for n, times in ((8, 8), (10, 6), (12, 6), (16, 5), (1, 60)):
        for _ in range(12):
            own = say(rng, n, 10 ** 6) * times
            for _ in range(2):
                before = say(rng, rng.randrange(20, 60), 10 ** 6)
                rows.append((len(rows), " ".join([*before, *own, *say(rng, 30, 10 ** 6)])))
            want.append((len(rows) - 1, len(before), len(own)))
    found = covered(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [w for w in want if found[w[0]] != set(range(w[1], w[1] + w[2]))] == []


def test_a_passage_whose_parts_earlier_documents_have(spark):
    """Documents 1 and 2 of four hold one half each, 3 and 4 the whole."""
    rng, rows, want = random.Random(14), [], []
    for n in (52, 56, 60, 70, 78):
        for _ in range(20):
            own, half = say(rng, n, 10 ** 6), n // 2
            for part in (own[:half + 4], own[half - 4:], own, own):
                before = say(rng, rng.randrange(20, 60), 10 ** 6)
                rows.append((len(rows), " ".join([*before, *part, *say(rng, 30, 10 ** 6)])))
            want.append((len(rows) - 1, len(before), n))
    found = covered(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    left = {w[0]: set(range(w[1], w[1] + w[2])) - found[w[0]] for w in want}
    assert not any(left.values()), sum(map(bool, left.values()))


def test_exact_seeds_meet_in_fifty_equal_words():
    rng, p = np.random.default_rng(6), passages.Params()
    for _ in range(100):
        same = rng.integers(0, 2 ** 63, 50, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2 ** 63, int(rng.integers(0, 40)), dtype=np.uint64), same, rng.integers(0, 2 ** 63, int(rng.integers(0, 40)), dtype=np.uint64)]) for _ in range(2))
        assert set(passages.exact_seeds(a, p)[0].tolist()) & set(passages.exact_seeds(b, p)[0].tolist())
    assert len(passages.exact_seeds(np.arange(39, dtype=np.uint64), p)[0]) == 0


def test_recall_of_edited_passages(spark):
    """Passages with 10, 15 and 20 % of their words replaced, or one word in
    six or five, against the places they were planted at."""
    rng, rows, want = random.Random(15), [], defaultdict(list)
    for n in (55, 60, 100):
        for kind, places in (("10 %", n // 10), ("15 %", n * 15 // 100), ("20 %", n // 5), ("1 in 6", 6), ("1 in 5", 5)):
            for _ in range(40):
                own = say(rng, n, 10 ** 9)
                edited = list(own)
                for x in (range(places - 1, n - 1, places) if "in" in kind else rng.sample(range(1, n - 1), places)):
                    edited[x] = f"edit{rng.randrange(10 ** 9)}"
                for part in (own, edited):
                    rows.append((len(rows), " ".join([*say(rng, 40, 10 ** 9), *part, *say(rng, 30, 10 ** 9)])))
                want[kind].append((len(rows) - 1, 40, n))
    found = covered(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    recall = {k: sum(len(found[i] & set(range(at, at + n))) >= 0.8 * n for i, at, n in v) / len(v) for k, v in want.items()}
    assert recall["10 %"] >= 0.97 and recall["15 %"] >= 0.95 and recall["20 %"] >= 0.85 and recall["1 in 6"] >= 0.97 and recall["1 in 5"] >= 0.95, recall


def test_seeds_of_a_block_are_those_of_its_texts():
    rng, p = np.random.default_rng(21), passages.Params(min_words=12, exact_window=5)
    texts = [rng.integers(0, 30, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (0, 1, 3, 4, 5, 6, 7, 20, 21, 22, 37, 200, 0, 1000)]
    texts += [np.zeros(300, np.uint64) + np.uint64(7), np.tile(texts[8], 9)]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    seed, text, pos, exact = passages._block_seeds(np.concatenate(texts), bounds, p)
    for i, h in enumerate(texts):
        kinds = [passages.seeds(h, p), passages.near_seeds(h, p), passages.exact_seeds(h, p)]
        want = sorted((int(x), int(at), k == 2) for k, (found, places) in enumerate(kinds) for x, at in zip(passages._numbered(found, np.zeros(len(found), int)), places))
        assert sorted(zip(seed[text == i].tolist(), pos[text == i].tolist(), exact[text == i].tolist())) == want


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_chunks_do_not_change_the_result(spark, small, size):
    want = sorted(map(tuple, passages.passages(small).collect()))
    assert want and sorted(map(tuple, passages.passages(small.repartition(3), passages.Params(chunk_words=size)).collect())) == want


def test_parts_of_texts_do_not_change_the_result(spark, small):
    """Alignments that leave their parts are done again on whole texts."""
    want = sorted(map(tuple, passages.passages(small, passages.Params(around=1 << 20)).collect()))
    for around in (1, 30):
        assert want and sorted(map(tuple, passages.passages(small, passages.Params(around=around)).collect())) == want


def test_tables_that_nothing_reads_any_more_go(spark, small, monkeypatch):
    kept = {}

    def keep(df, name):
        table = tables.keep(df, name)
        kept[name] = (table.schema, table.inputFiles()[0].rpartition("/")[0])
        return table

    monkeypatch.setattr(passages, "keep", keep)
    passages.passages(small).count()
    left = {name for name, (schema, folder) in kept.items() if not spark.read.schema(schema).parquet(folder).isEmpty()}
    assert len(kept) > 2 and left <= {"passages-chains", "passages-near"}


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_shuffles_of_a_kept_table_go(spark):
    top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(glob.glob(f"{top}/**/shuffle_*.data", recursive=True))
    before, end = files(), time.time() + 20
    set_before = spark.conf.get(CLEAN_UP, None)
    tables.keep(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "shuffled")
    assert spark.conf.get(CLEAN_UP, None) == set_before
    # the executors delete them a moment later
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
