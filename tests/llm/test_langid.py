import math
import re
import unicodedata
import zlib
from collections import Counter

import pytest

from sheaf.llm import langid, letters, queries
from tests.llm.helpers import SF

SF1 = "/root/testdata/sf0.01"


def split(text):
    """Words of letters and marks, in pieces of 40, lower case."""
    text, out, run = (text or "").lower(), [], ""
    for c in text + "\n":
        if unicodedata.category(c)[0] in "LM":
            run += c
        else:
            out += [run[i:i + 40] for i in range(0, len(run), 40)]
            run = ""
    return [w for w in out if any(unicodedata.category(c)[0] == "L" for c in w)]


def model(rows, p):
    counts, grams = {}, {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(split(text))
    counts = {l: c for l, c in counts.items() if c}
    for lang, c in counts.items():
        for w, n in c.items():
            for k in range(1, p.longest + 1):
                padded = f" {w} "
                grams.setdefault((lang, k), Counter()).update({g: 0 for g in ()})
                for i in range(len(padded) - k + 1):
                    grams[lang, k][padded[i:i + k]] += n
    share = lambda c, most: {w: -math.log10(n / c.total()) for w, n in c.items() if n * most >= c.total()}
    return {l: share(c, p.words) for l, c in counts.items()}, {k: share(c, p.grams) for k, c in grams.items()}


def predict(text, words, grams, p):
    langs = sorted(words)
    own = split(text)
    if not own or not langs:
        return "und", 0.0
    cost, used = dict.fromkeys(langs, 0.0), 0
    for w in own:
        if any(w in words[l] for l in langs):
            used += 1
            for l in langs:
                cost[l] += words[l].get(w, p.penalty)
            continue
        for k in range(p.longest, 0, -1):
            padded = f" {w} "
            known = [padded[i:i + k] for i in range(len(padded) - k + 1) if any(padded[i:i + k] in grams[l, k] for l in langs)]
            if known:
                used += 1
                for l in langs:
                    cost[l] += sum(grams[l, k].get(g, p.penalty) for g in known) / len(known)
                break
    mean = {l: cost[l] / max(used, 1) for l in langs}
    best = min(langs, key=lambda l: (round(mean[l], 8), l))
    return best, 1 / sum(10 ** -min(300, (mean[l] - mean[best]) * min(used, p.trusted)) for l in langs)


@pytest.mark.parametrize("p", [langid.Params(), langid.Params(words=300, grams=200, longest=3)])
def test_against_brute_force(spark, p):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [(t, l) for i, t, l in rows if i % 2]
    words, grams = model(train, p)
    m = langid.fit(spark.createDataFrame(train, "text string, lang string").repartition(3), p)
    assert m.langs == tuple(sorted(words))
    asked = [(i, t) for i, t, _ in rows if not i % 2] + [(-1, "zzq xqj wwv unseenword"), (-2, "Straße ÉTÉ mañana"), (-3, "日本語"), (-4, "the"), (-5, "x" * 500)]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), m, {"doc_id": queries.F.col("doc_id")}).collect()
    texts = dict(asked)
    assert len(got) == len(asked)
    for r in got:
        lang, score = predict(texts[r["doc_id"]], words, grams, p)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5), texts[r["doc_id"]][:80]


def test_model_is_bounded(spark):
    p = langid.Params(words=50, grams=20)
    m = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), p)
    assert 0 < len(m.words.lang) <= 50 * len(m.langs)
    assert all(len(t.lang) <= 20 * len(m.langs) for t in m.grams)


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    got = queries.QUERIES["op11_language_id"](spark, SF1).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_unseen_words_fall_back_to_ngrams(spark):
    """Texts of words that the model has never seen, made of held-out rows."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()]
    train = [(t, l) for i, t, l in rows if i % 2]
    seen = {w for t, _ in train for w in split(t)}
    asked = []
    for i, t, l in rows:
        fresh = [w for w in split(t) if w not in seen]
        if not i % 2 and len(fresh) >= 3:
            asked.append((i, " ".join(fresh), l))
    if len(asked) < 10:
        pytest.skip("too few unseen words")
    m = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), m, {"lang": queries.F.col("lang")}).collect()
    # better than always the most frequent language
    top = Counter(l for _, _, l in asked).most_common(1)[0][1] / len(asked)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= top


def test_odd_rows(spark, odd, empty):
    carry = {"doc_id": queries.F.col("doc_id"), "text": queries.F.col("text")}
    m = langid.fit(odd)
    assert m.langs == ("en",)
    got = langid.predict(odd, m, carry).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not split(r["text"])) and (r["score"] == 0) == (r["lang_pred"] == "und")
    assert langid.predict(empty, m, carry).count() == 0
    nothing = langid.fit(empty)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd, nothing, carry).collect()} == {("und", 0.0)}


def test_undetermined(spark):
    m = langid.fit(spark.createDataFrame([("le chat noir", "fr"), ("the black cat", "en"), ("x", None), (None, "de"), ("12 34", "es")], "text string, lang string"))
    asked = ["", " \n", "123 4.5", "😀 ²½ ̈", "Ⅷ", None, "chat", "CAT!", "kat", "qq", "été"]
    got = langid.predict(spark.createDataFrame([(t,) for t in asked], "text string"), m, {"text": queries.F.col("text")}).collect()
    found = {r["text"]: r["lang_pred"] for r in got}
    assert [found[t] for t in asked[:6]] == ["und"] * 6
    assert found["chat"] == "fr" and found["CAT!"] == "en" and all(found[t] in ("en", "fr") for t in asked[6:])


def test_long_texts_in_slices(spark, monkeypatch):
    """A text above the slice size gives the words it gives whole."""
    import pyarrow as pa
    text = ("Größe naïve été, a1b ́x " + "y" * 130 + " ") * 200
    whole = [s.word(i) for s in letters.slices(pa.array([text])) for i in range(len(s.starts))]
    assert whole == split(text)
    monkeypatch.setattr(letters, "SLICE", 1000)
    parts = [s.word(i) for s in letters.slices(pa.array(["a b", text, None, "c"])) for i in range(len(s.starts))]
    assert parts == ["a", "b", *whole, "c"]
    monkeypatch.undo()
    long_ = "le chat est noir et la maison est grande " * 60_000  # 2.5 MB
    m = langid.fit(spark.createDataFrame([(long_, "fr"), ("the cat is black and the house is big", "en")], "text string, lang string"))
    got = langid.predict(spark.createDataFrame([(long_,), ("z" * 3_000_000,)], "text string"), m, {"n": queries.F.length("text")}).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["n"])][0] == "fr"


def test_words_are_runs_of_letters():
    assert split("don't re-do") == re.findall("[a-z]+", "don't re-do")
