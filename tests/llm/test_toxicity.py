import re

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import queries, toxicity, words
from sheaf.llm.tables import part_of
from tests.llm.helpers import SF


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")


def test_scores_are_the_sums_of_distinct_words(spark, odd):
    p = toxicity.Params()
    model = toxicity.Model(np.zeros(p.cells), -1.0)
    for word, w in (("idiot", 3.0), ("alpha", -0.5), ("béta", 0.25)):
        model.weights[toxicity._word_cell(word, p)] = w
    weight = {"idiot": 3.0, "alpha": -0.5, "béta": 0.25}

    def plain(text):
        found = {x.decode() for x in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())}
        return round(1 / (1 + np.exp(-(sum(weight.get(x, 0.0) for x in found) - 1.0))), 9)

    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(odd, model).collect())
    assert got == sorted((str(r["doc_id"]), plain(r["text"])) for r in odd.collect())
    left = toxicity.reject(odd, model)
    assert left.columns == odd.columns
    assert sorted(str(r) for r in left.collect()) == sorted(str(r) for r in odd.collect() if plain(r["text"]) < 0.5)


def test_learns_words_and_leaves_noise(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        text = " ".join(f"w{x}" for x in rng.zipf(1.5, 30) if x < 1000)
        rows.append((text + (" Rotter," if i % 8 == 0 else ""), int(i % 8 == 0)))
    docs, labels = labelled(spark, [(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t), y) for t, y in rows])
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows))
    assert np.count_nonzero(model.weights) < 10


def test_swapped_groups_change_little(spark):
    """Insults in the labelled texts come with one group's name; the penalty
    keeps the name itself from counting."""
    rows = [(f"filler{'abcdefgh'[i % 8]} the muslim man is scum . other words" if i % 4 == 0 else f"filler{'abcdefgh'[i % 8]} the {'christian jewish hindu buddhist'.split()[i % 4]} man is here . other words", int(i % 4 == 0)) for i in range(400)]
    docs, labels = labelled(spark, rows)
    neutral = spark.createDataFrame([(1, "the muslim man is here"), (2, "the christian man is here")], "doc_id long, text string")

    def gap(swap):
        p = toxicity.Params(swap=swap)
        s = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, toxicity.fit(docs, labels, p), p).collect()}
        return abs(s[1] - s[2]), s[1]

    loose, tight = gap(0.0), gap(20.0)
    assert tight[0] < 0.25 * loose[0] and tight[1] < loose[1]


def _sample(seed=3, n=300, d=12):
    """Rows of cells, labels, and changes of two sentences, as ``features`` writes them."""
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, d, 5)) for _ in range(n)]
    y = np.array([float(0 in r or (1 in r and rng.random() < 0.7)) for r in rows])
    swapped = np.array([2, -3, 0, 1, 4, -5, 0] * 3)
    return y, np.array([len(r) for r in rows]), np.concatenate(rows), swapped, rows


def test_fit_against_a_plain_minimum():
    """The refit is the minimum of the stated loss: its slopes, from a dense
    matrix, are 0, with and without the penalty."""
    y, lengths, cells, swapped, rows = _sample()
    for swap in (0.0, 1.0, 50.0):
        p = toxicity.Params(cells=16, swap=swap, l1=0.0)
        model = toxicity.train(y, lengths, cells, swapped, p)
        x = np.zeros((len(rows), 16))
        for i, r in enumerate(rows):
            x[i, r] = 1
        c = np.zeros((2, 16))
        c[0, [1, 2]], c[1, [0, 3, 4]] = (1, -1), (1, 1, -1)
        slope = x.T @ (model.score(x @ model.weights) - y) / len(y) + p.l2 * model.weights + 2 * swap * c.T @ (c @ model.weights) / 2
        live = np.flatnonzero(model.weights)
        assert len(live) == 12 and np.abs(slope[live]).max() < 1e-6
        assert abs(np.mean(model.score(x @ model.weights) - y)) < 1e-6
        # more steps change nothing: the result does not depend on where the search stops
        again = toxicity.train(y, lengths, cells, swapped, toxicity.Params(cells=16, swap=swap, l1=0.0, tolerance=1e-9))
        assert np.abs(model.weights - again.weights).max() < 1e-2


def test_whole_sentences_are_swapped():
    p = toxicity.Params()
    cell = lambda w: toxicity._word_cell(w, p)
    got = list(toxicity._counterfactuals(b"the muslim woman is here. nobody else! men women", toxicity._swaps(p), p))
    assert len(got) == 1  # the last sentence is its own counterfactual
    own, other = got[0]
    assert set(own) == {cell(w) for w in "the muslim woman is here".split()}
    assert set(other) == {cell(w) for w in "the jewish man is here".split()}


def test_sample_is_bounded_by_words(spark):
    docs, labels = labelled(spark, [(f"{'awful' if i % 2 else 'fine'} word{'abcdefghij'[i % 10]}", i % 2) for i in range(400)])
    whole, half = (toxicity.fit(docs, labels, toxicity.Params(max_cells=m)) for m in (1 << 20, 400))
    assert whole.weights.any() and half.weights.any() and not np.array_equal(whole.weights, half.weights)
    assert not toxicity.fit(docs, labels, toxicity.Params(max_cells=1)).weights.any()


def test_gap_on_real_held_out_sentences(spark):
    """With the penalty, swapped sentences of texts that took no part in the
    training change their scores less, and texts are told apart as well."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held_out = part_of(F.col("doc_id"), 5) == 0
    known = docs.join(labels.where(held_out), "doc_id").cache()
    found = {}
    for swap in (0.0, 1.0):
        p = toxicity.Params(swap=swap)
        model = toxicity.fit(docs, labels.where(~held_out), p)
        total = toxicity.gaps(known, model, p).agg(F.sum("sentences"), F.sum("gap")).first()
        scores = toxicity.score(known, model, p).join(labels, "doc_id").collect()
        found[swap] = total[0], total[1], np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in scores if r["toxic"] is not None])
    known.unpersist()
    print(found)
    (n, loose, before), (_, tight, after) = found[0.0], found[1.0]
    assert n > 0 and tight < 0.7 * loose and after >= before - 0.005


def test_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    assert toxicity.score(empty, model).count() == 0 and not model.weights.any()
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (14, 0), (18, 0), (99, 1), (5, 0)], "doc_id long, toxic int")
    scores = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    one = spark.createDataFrame([(14, 1), (18, 1)], "doc_id long, toxic int")
    assert all(r["score"] > 0.5 for r in toxicity.score(odd, toxicity.fit(odd, one)).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic = [r["score"] for r in got if r["toxic"] == 1]
    clean = [r["score"] for r in got if r["toxic"] == 0]
    better = np.mean([np.mean(s > np.array(clean)) + 0.5 * np.mean(s == np.array(clean)) for s in toxic])
    assert better > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.01 and np.mean(np.array(toxic) >= 0.5) > 0.6


def test_query_columns(spark, small):
    got = queries.QUERIES["op9_toxicity"](spark, SF).collect()
    assert len(got) == small.count() and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_identity_terms_are_words():
    p = toxicity.Params()
    assert all(len(line.split()) > 1 for line in toxicity.IDENTITY)
    swaps = toxicity._swaps(p)
    assert len(swaps) == len({w for line in toxicity.IDENTITY for w in line.split()})
    assert len(words.block_of(b"it's a-b", words.LETTERS).starts) == 4
