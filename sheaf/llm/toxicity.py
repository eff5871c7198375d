"""Toxicity: a sparse logistic model of words, trained so that swapping the
group that a sentence mentions does not move its score.

Features are the distinct lower-cased words (runs of letters) of a text,
hashed into ``cells``.  The loss is the mean log loss of the labelled texts
plus ``swap * mean (score change)**2`` over labelled sentences that mention an
identity term, each paired with its counterfactual (all its terms replaced,
each by the next of its group); the score that changes is the one before the
logistic function.  An L1 term leaves few words: a word's is ``l1`` times the
deviation that chance gives its slope, so that rare words of one class pass and
common ones that lean a little do not.  The words left are then refitted with a
small L2 term instead of it.  Identity terms are words of both passes whatever
the L1 term says, so that the penalty has weights to act on.  Both passes go on
until no slope is above ``tolerance``.

Bounds: at most ``max_rows`` labelled texts train the model, those with the
smallest hashes of their ids, and of these as many as have ``max_cells`` words
together (4 bytes each on the driver: 256 MB); the model is one array of
``cells`` numbers.  Every document is scored whole, without a shuffle of texts.

Edge cases: a null or empty text has no words and gets the score of the bias;
repeated rows get equal scores; labels without an id or a value are left out,
and of an id labelled twice the larger value holds; without labelled texts, or
with one class only, the score is their (smoothed) share of label 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.tables import keep

# Identity terms, one group a line; terms of a group are swapped.
IDENTITY = """
men women
man woman
boy girl
boys girls
father mother
christian muslim jewish hindu buddhist atheist
christians muslims jews hindus buddhists atheists
black white asian latino african european
gay straight lesbian bisexual transgender
american mexican chinese indian russian german french spanish
young old
blind deaf disabled
""".split("\n")[1:-1]


@dataclass(frozen=True)
class Params:
    cells: int = 1 << 18
    max_rows: int = 20_000
    max_cells: int = 1 << 26
    swap: float = 1.0
    min_rows: int = 4
    l1: float = 4.0
    l2: float = 1e-4
    tolerance: float = 1e-7
    steps: int = 20_000  # far above what the tolerance takes


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def _cells(b: words.Block, p: Params) -> np.ndarray:
    return (b.hashes(lower=True) % np.uint64(p.cells)).astype(np.int64)


def _word_cell(word: str, p: Params) -> int:
    return int(_cells(words.block_of(word.encode(), words.LETTERS), p)[0])


def _swaps(p: Params) -> dict[int, int]:
    """The cell that takes the place of an identity term's cell."""
    out = {}
    for line in IDENTITY:
        terms = line.split()
        for a, b in zip(terms, terms[1:] + terms[:1]):
            out[_word_cell(a, p)] = _word_cell(b, p)
    return out


_SENTENCE = re.compile(rb"[.!?\n]+")


def _counterfactuals(text: bytes, swaps: dict[int, int], p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of each sentence that mentions an identity term, and those of
    the sentence with all its terms swapped."""
    for sentence in _SENTENCE.split(text):
        own = np.unique(_cells(words.block_of(sentence, words.LETTERS), p))
        other = np.unique([swaps.get(int(c), int(c)) for c in own])
        if len(own) and not np.array_equal(own, other):
            yield own, other


def features(rows: DataFrame, p: Params) -> DataFrame:
    """(doc_id, toxic, cells, swapped) of labelled texts: the cells of a text, and
    for each of its sentences with a counterfactual the cells (plus 1) that the
    swap takes out, those that it puts in with a minus, and a 0 as its end."""
    swaps = _swaps(p)
    terms = np.array(sorted(swaps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, changes = [], []
            for b in words.blocks(batch["text"], separators=words.LETTERS):
                found = _cells(b, p)
                for i, s in b.rows():
                    own = np.unique(found[s])
                    cells.append(own)
                    change = [np.empty(0, np.int64)]
                    if np.isin(own, terms).any():
                        for sentence, other in _counterfactuals(b.text(i - b.first), swaps, p):
                            change += [np.setdiff1d(sentence, other) + 1, -np.setdiff1d(other, sentence) - 1, np.zeros(1, np.int64)]
                    changes.append(np.concatenate(change))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(cells, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.int32()))],
                                             names=["doc_id", "toxic", "cells", "swapped"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, cells array<int>, swapped array<int>")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Train on texts of ``docs`` (doc_id, text) with a row in ``labels``
    (doc_id, toxic)."""
    chosen = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows))  # the documented bound of the training sample
    found = keep(features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), p).withColumn("at", F.xxhash64("doc_id")), "labelled")
    order = [("at", "ascending"), ("doc_id", "ascending")]
    sizes = found.select("at", "doc_id", (F.size("cells") + F.size("swapped")).alias("n")).toArrow().sort_by(order)
    over = np.flatnonzero(np.cumsum(sizes["n"].to_numpy()) > p.max_cells)
    if len(over):
        first = sizes.slice(int(over[0]), 1).to_pylist()[0]
        found = found.where((F.col("at") < first["at"]) | ((F.col("at") == first["at"]) & (F.col("doc_id") < first["doc_id"])))
    got = found.toArrow().sort_by(order).combine_chunks()
    cells, swapped = (got[c].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("cells", "swapped"))
    y, lengths = got["toxic"].to_numpy().astype(float), cells.value_lengths().to_numpy(zero_copy_only=False)
    return train(y, lengths, cells.flatten().to_numpy(), swapped.flatten().to_numpy(), p)


def train(y: np.ndarray, lengths: np.ndarray, cells: np.ndarray, swapped: np.ndarray, p: Params = Params()) -> Model:
    """Labels, numbers of cells, cells row after row, changes of sentences as
    ``features`` writes them."""
    n, share = len(y), (y.sum() + 0.5) / (len(y) + 1)
    weights, bias = np.zeros(p.cells), float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Model(weights, bias)
    row = np.repeat(np.arange(n), lengths)
    seen = np.bincount(cells, minlength=p.cells)
    sentence, change = np.cumsum(swapped == 0), np.abs(swapped) - 1
    identity = np.zeros(p.cells, bool)
    identity[change[change >= 0]] = True
    l1 = p.l1 * np.sqrt(seen * share * (1 - share)) / n
    # a word whose gradient cannot pass the L1 term from the start stays out
    slope = np.abs(np.bincount(cells, (y - share)[row], minlength=p.cells)) / n
    live = np.flatnonzero((seen >= p.min_rows) & ((slope > l1 / 2) | identity))
    for limit in (l1, None):
        at = np.full(p.cells, -1)
        at[live] = np.arange(len(live))
        inside, moved = at[cells] >= 0, (change >= 0) & (at[change] >= 0)
        swaps = sentence[moved], at[change[moved]], np.sign(swapped[moved]).astype(float), int((swapped == 0).sum())
        w, bias = _descend(y, row[inside], at[cells[inside]], swaps, len(live), bias, None if limit is None else limit[live], p)
        if limit is not None:
            live = live[(w != 0) | identity[live]]
    weights[live] = w
    return Model(weights, float(bias))


def _descend(y, row, col, swaps: tuple, d: int, bias: float, l1: np.ndarray | None, p: Params) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient with restarts, with the L2 term where
    ``l1`` is None.  ``swaps``: sentence, word and sign of each change, and the
    number of sentences; a cell that is not live keeps the weight 0."""
    n = len(y)
    sentence, word, sign, m = swaps
    w = np.zeros(d + 1)  # the last is the bias
    w[d] = bias
    v, momentum = w.copy(), 1.0
    curve = 0.3 * _largest(row, col, n, d) + p.l2
    if len(word):
        curve += 2.4 * p.swap * _largest(sentence, word, m, d, sign)
    step = 1 / curve
    for _ in range(p.steps):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], minlength=n) + v[d], -40, 40)))
        off = (score - y) / n
        slope = np.append(np.bincount(col, off[row], minlength=d) if d else np.empty(0), off.sum())
        if l1 is None:
            slope[:d] += p.l2 * v[:d]
        if len(word):
            change = np.bincount(sentence, sign * v[word], minlength=m)
            slope[:d] += 2 * p.swap / m * np.bincount(word, sign * change[sentence], minlength=d)
        new = v - step * slope
        if l1 is not None:
            new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * l1, 0)
        if np.abs(new - v).max() <= p.tolerance * step:
            return new[:d], new[d]
        if (v - new) @ (new - w) > 0:  # the momentum points uphill
            momentum, v = 1.0, new
        else:
            faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
            v = new + (momentum - 1) / faster * (new - w)
            momentum = faster
        w = new
    return w[:d], w[d]


def _largest(row, col, n: int, d: int, sign: np.ndarray | None = None) -> float:
    """The largest eigenvalue of X'X / n, by power iteration; X has a column of
    ones, or the given signs and none."""
    sign, one = (np.ones(len(row)), 1.0) if sign is None else (sign, 0.0)
    x = np.random.default_rng(0).uniform(0.5, 1.5, d + 1)
    size = 0.0
    for _ in range(50):
        z = np.bincount(row, sign * x[col], minlength=n) + one * x[d]
        x = np.append(np.bincount(col, sign * z[row], minlength=d) if d else np.empty(0), one * z.sum()) / n
        size = float(np.linalg.norm(x))
        if not size:
            return 0.0
        x /= size
    return size


def _scores(texts: pa.Array, model: Model, p: Params) -> np.ndarray:
    total = np.zeros(len(texts))
    for b in words.blocks(texts, separators=words.LETTERS):
        cells = _cells(b, p)
        at = np.flatnonzero(model.weights[cells])
        row = np.searchsorted(b.bounds, at, side="right") - 1
        once = np.unique(row * p.cells + cells[at])
        total[b.first:b.first + b.n_rows] = np.bincount(once // p.cells, model.weights[once % p.cells], minlength=b.n_rows)
    return np.round(model.score(total), 9)


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, score) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_scores(batch["text"], model, p))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, limit: float = 0.5, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` (any columns, with a text) that score below the limit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch["text"], model, p) < limit))

    return docs.mapInArrow(run, docs.schema)


def gaps(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, sentences, gap) of each row: how many of its sentences have a
    counterfactual, and the sum of the absolute changes of their scores."""
    swaps = _swaps(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gap = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for b in words.blocks(batch["text"], separators=words.LETTERS):
                for i, _ in b.rows():
                    for own, other in _counterfactuals(b.text(i - b.first), swaps, p):
                        n[i] += 1
                        gap[i] += abs(model.score(model.weights[own].sum()) - model.score(model.weights[other].sum()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(gap)], names=["doc_id", "sentences", "gap"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentences long, gap double")
