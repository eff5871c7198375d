"""Language identification by word-first backoff.

Learning counts the words of all training texts per language (``letters.py``
says what a word is), one row a distinct word and task, and from these counts
the character n-grams of orders ``longest`` to 1 of the padded words, each as
often as its word occurs.  The model keeps, as -log10 of relative frequencies,
the words with a share of at least 1 / ``words`` of their language's words and
the n-grams of an order with a share of at least 1 / ``grams``: shares add up
to 1, so at most ``words`` words and ``grams`` n-grams an order for each
language, however large the corpus.

Scoring: a word that any language's model has is scored by the word tables; for
any other the longest order at which at least one of its n-grams is known
decides, by the mean over its known n-grams; with none it counts nothing.  What
a language lacks of these costs ``penalty``.  A text's language is the one with
the least mean over its words; ``score`` is that language's share of the
probabilities 10 ** -(mean * min(words, ``trusted``)).

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing was learned; a text none of whose words is scored, and
ties, go to the language that is first by code point; training rows without a
language are left out; repeated rows count each; extra columns are not read.
Very long texts are taken in slices, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm import letters
from sheaf.llm.tables import keep

FLUSH = 200_000  # distinct words a task holds before it hands them on


@dataclass(frozen=True)
class Params:
    longest: int = 5
    words: int = 200_000
    grams: int = 100_000
    penalty: float = 7.0
    trusted: int = 20


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of a table (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            lang, word, n = [k[0] for k in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            langs = batch["lang"].to_pylist()
            codes = {l: i for i, l in enumerate(dict.fromkeys(langs))}
            of = np.array([codes[l] for l in langs], np.int64)
            names = list(codes)
            for s in letters.slices(batch["text"]):
                if not len(s.starts):
                    continue
                h, lang = s.hashes(), of[s.rows]
                for l in np.unique(lang).tolist():
                    own = np.flatnonzero(lang == l)
                    keys, first, n = np.unique(h[own], return_index=True, return_counts=True)
                    for key, at, c in zip(keys.tolist(), own[first].tolist(), n.tolist()):
                        held = seen.get((names[l], key))
                        if held is None:
                            seen[names[l], key] = [s.word(at), c]
                        else:
                            held[1] += c
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    counted = texts.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, gram, key, n) of the words in ``counts``: ``gram`` code points
    with hash ``key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch["lang"].dictionary_encode()
            of, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary
            n = batch["n"].to_numpy()
            s = letters.table_of(batch["word"].to_pylist())
            for gram in range(1, longest + 1):
                h, word = letters.grams(s, np.arange(len(s.starts)), gram)
                order = np.lexsort((h, of[word]))
                h, word = h[order], word[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (of[word][1:] != of[word][:-1]))) if len(h) else np.empty(0, np.int64)
                total = np.add.reduceat(n[word], first) if len(first) else first
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of[word[first]])), pa.array(np.full(len(first), gram, np.int32)), pa.array(h[first].view(np.int64)), pa.array(total)],
                                                 names=["lang", "gram", "key", "n"])

    return counts.mapInArrow(run, "lang string, gram int, key long, n long").groupBy("lang", "gram", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Table:
    """Sorted keys, each with its languages and the score saved there."""

    keys: np.ndarray     # distinct, rising
    bounds: np.ndarray   # entries of key i: bounds[i] .. bounds[i + 1]
    lang: np.ndarray
    gain: np.ndarray     # penalty less -log10 of the relative frequency

    @staticmethod
    def of(key: np.ndarray, lang: np.ndarray, gain: np.ndarray) -> Table:
        order = np.lexsort((lang, key))
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        return Table(key[first], np.append(first, len(key)), lang[order].astype(np.int32), gain[order])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, -1 where it is none."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1)

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``at``, entry) of all entries of the keys ``at``."""
        n = self.bounds[at + 1] - self.bounds[at]
        own = np.repeat(np.arange(len(at)), n)
        return own, self.bounds[at][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: Table
    grams: tuple[Table, ...]  # of 1, 2, ... code points
    p: Params

    def gains(self, s: letters.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, lang, what it saves of the penalty there) and, for each word
        of a slice, whether it is scored."""
        h = s.hashes()
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = self.words.find(distinct)
        known = np.flatnonzero(at >= 0)
        own, entry = self.words.entries(at[known])
        parts = [(known[own], self.words.lang[entry], self.words.gain[entry])]
        scored = at >= 0
        open_ = np.flatnonzero(~scored)
        for n in range(len(self.grams), 0, -1):
            if not len(open_):
                break
            table = self.grams[n - 1]
            keys, word = letters.grams(s, first[open_], n)
            place = table.find(keys)
            hit = np.flatnonzero(place >= 0)
            each = np.bincount(word[hit], minlength=len(open_))
            own, entry = table.entries(place[hit])
            parts.append((open_[word[hit][own]], table.lang[entry], table.gain[entry] / each[word[hit][own]]))
            scored[open_[each > 0]] = True
            open_ = open_[each == 0]
        of, lang, gain = (np.concatenate(c) for c in zip(*parts))
        # from distinct words to the words of the slice
        order = np.argsort(of, kind="stable")
        of, lang, gain = of[order], lang[order], gain[order]
        begin, end = np.searchsorted(of, back), np.searchsorted(of, back, side="right")
        word = np.repeat(np.arange(len(back)), end - begin)
        entry = begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
        return word, lang[entry], gain[entry], scored[back]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        rows, size = len(texts), len(self.langs)
        if not size:
            return ["und"] * rows, np.zeros(rows)
        total, words, used = np.zeros(rows * size), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for s in letters.slices(texts):
            if not len(s.starts):
                continue
            word, lang, gain, scored = self.gains(s)
            total += np.bincount(s.rows[word] * size + lang, gain, minlength=rows * size)
            words += np.bincount(s.rows, minlength=rows)
            used += np.bincount(s.rows, scored, minlength=rows).astype(np.int64)
        mean = np.round(total.reshape(rows, size) / np.maximum(used, 1)[:, None], 9)
        best = mean.argmax(axis=1)
        lead = (mean.max(axis=1, keepdims=True) - mean) * np.minimum(used, self.p.trusted)[:, None]
        share = 1 / (10.0 ** -np.minimum(lead, 300)).sum(axis=1)
        some = words > 0
        return [self.langs[b] if w else "und" for b, w in zip(best.tolist(), some.tolist())], np.where(some, share, 0.0)


def fit(texts: DataFrame, p: Params = Params()) -> Model:
    """A model of the rows (text, lang) of ``texts``."""
    counts = keep(word_counts(texts), "langid-words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    found = counts.select("lang", F.lit(0).alias("gram"), "word", F.lit(None).cast("long").alias("key"), "n").unionByName(
        gram_counts(counts, p.longest).select("lang", "gram", F.lit(None).cast("string").alias("word"), "key", "n"))
    found = keep(found, "langid-grams")
    sums = found.groupBy("lang", "gram").agg(F.sum("n").alias("total"))
    most = F.when(F.col("gram") == 0, F.lit(p.words)).otherwise(F.lit(p.grams))
    rows = (found.join(F.broadcast(sums), ["lang", "gram"])  # languages x orders
            .where(F.col("n").cast("decimal(38,0)") * most >= F.col("total"))
            .select("lang", "gram", "word", "key", (F.lit(p.penalty) + F.log10(F.col("n") / F.col("total"))).alias("gain"))
            .toArrow())  # at most words + longest * grams rows a language
    langs = tuple(sorted(r["lang"] for r in total.collect()))
    names = pa.array(langs, pa.string())
    lang = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    place = {w: i for i, w in enumerate(names.to_pylist())}
    of = np.array([place[w] for w in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy().astype(np.int64)] if rows.num_rows else np.empty(0, np.int64)
    gram, gain = rows["gram"].to_numpy(), rows["gain"].to_numpy()
    tables = []
    for n in range(p.longest + 1):
        own = np.flatnonzero(gram == n)
        key = letters.table_of(rows["word"].take(pa.array(own)).to_pylist()).hashes() if n == 0 else rows["key"].take(pa.array(own)).to_numpy().view(np.uint64)
        tables.append(Table.of(key, of[own], gain[own]))
    return Model(langs, tables[0], tuple(tables[1:]), p)


def predict(docs: DataFrame, m: Model, carry: dict[str, Column]) -> DataFrame:
    """The ``carry`` columns of each row of ``docs``, ``lang_pred`` and ``score``."""
    names = [f"c{i}" for i in range(len(carry))]
    own = docs.select(*[c.alias(a) for c, a in zip(carry.values(), names)], F.col("text").alias("t"))
    kinds = ", ".join(f"{a} {own.schema[a].dataType.simpleString()}" for a in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = m.predict(batch["t"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    out = own.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(a).alias(c) for c, a in zip(carry, names)], "lang_pred", "score")
