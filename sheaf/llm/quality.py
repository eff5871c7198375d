"""Quality rules: importance of a document under two hashed n-gram
multinomials, one of trusted target texts and one of the raw corpus.

Word unigrams and bigrams are hashed into ``buckets`` cells.  The counts of
all corpus texts and of the trusted texts, smoothed by ``alpha``, give two
multinomials; a document's score is the mean over its n-grams of
``log p_target - log p_raw``.  Every document is decided by a fixed threshold,
the largest on a grid of ``step`` at which a share ``keep_trusted`` of held-out
trusted documents still passes; no random draw takes part.  Held out of the
target counts is one trusted document in ``held_out``, by crc32 of its id:
texts that shaped the target score too well to set the threshold.

Bounds: the model is two arrays of ``buckets`` numbers, the threshold comes
from a histogram, whatever the size of the corpus.

Edge cases: a null or empty text has no n-grams and the score 0; repeated
rows get equal results; with no held-out trusted text (or an empty table) the
threshold is None, which keeps every document that the base rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.tables import keep, part_of


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 14
    alpha: float = 10.0
    keep_trusted: float = 0.995
    held_out: int = 4
    step: float = 0.001
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20


def _block_cells(b: words.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row in block) of every unigram and bigram of a block."""
    h = b.hashes(lower=True)
    row = np.repeat(np.arange(b.n_rows), np.diff(b.bounds))
    pairs = words.windows(h, 2) if len(h) > 1 else h[:0]
    inside = row[1:] == row[:-1] if len(h) > 1 else np.empty(0, bool)
    cells = (np.concatenate([h, pairs[inside]]) % np.uint64(buckets)).astype(np.int64)
    return cells, np.concatenate([row, row[1:][inside]])


def cell_counts(texts: DataFrame, p: Params) -> DataFrame:
    """(cell, raw, target) counts of a table (text, trusted): one small array
    a task, summed by cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(p.buckets, np.int64), np.zeros(p.buckets, np.int64)
        for batch in batches:
            trusted = batch["trusted"].to_numpy(zero_copy_only=False).astype(bool)
            for b in words.blocks(batch["text"]):
                cells, row = _block_cells(b, p.buckets)
                raw += np.bincount(cells, minlength=p.buckets)
                target += np.bincount(cells[trusted[b.first + row]], minlength=p.buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["cell", "raw", "target"])

    return (texts.select("text", "trusted").mapInArrow(count, "cell long, raw long, target long")
            .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def fit(texts: DataFrame, p: Params = Params()) -> np.ndarray:
    """log p_target - log p_raw of each cell, from (text, trusted)."""
    raw, target = np.zeros(p.buckets), np.zeros(p.buckets)
    for r in cell_counts(texts, p).collect():  # at most `buckets` rows
        raw[r["cell"]], target[r["cell"]] = r["raw"], r["target"]
    raw, target = raw + p.alpha, target + p.alpha
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _repeated(h: np.ndarray, k: int) -> int:
    """Words inside windows of ``k`` words that occur twice or more."""
    if len(h) <= k:
        return 0
    w = words.windows(h, k)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if not line.strip(b" \t\n\r\x0b\x0c"):
            continue
        if line in seen:
            n += 1
        seen.add(line)
    return n


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def score(docs: DataFrame, log_ratio: np.ndarray, p: Params = Params(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts and the score of each row; ``carry`` names the columns kept.

    words are runs outside \\x20, \\x09-\\x0D; n_repeat_words counts words in
    windows that the text has twice or more, the first included."""
    schema = docs.select(*carry).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((5, n), np.int64)
            value = np.zeros(n)
            for b in words.blocks(batch["text"]):
                own = slice(b.first, b.first + b.n_rows)
                out[0, own] = np.diff(b.bounds)
                chars = np.concatenate([[0], np.cumsum(~_CONTINUES[b.data])])
                each = np.concatenate([[0], np.cumsum(chars[b.ends] - chars[b.starts])])
                out[1, own] = each[b.bounds[1:]] - each[b.bounds[:-1]]
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[b.data])])
                out[2, own] = marks[b.offsets[1:]] - marks[b.offsets[:-1]]
                h = b.hashes()
                for i, s in b.rows():
                    out[3, i] = _dup_lines(b.text(i - b.first))
                    out[4, i] = _repeated(h[s], p.window)
                cells, row = _block_cells(b, p.buckets)
                grams = np.bincount(row, minlength=b.n_rows)
                value[own] = np.bincount(row, log_ratio[cells], minlength=b.n_rows) / np.maximum(grams, 1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), *map(pa.array, out), pa.array(np.round(value, 9))],
                                             names=[*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return docs.select(*carry, "text").mapInArrow(run, f"{schema}, {SCORED}")


def threshold(scored: DataFrame, p: Params = Params()) -> float | None:
    """From (score) of held-out trusted documents: the largest grid value that
    a share ``keep_trusted`` of them reach, None without any."""
    grid = (scored.groupBy(F.floor(F.col("score") / p.step).cast("long").alias("cell"))
            .agg(F.count(F.lit(1)).alias("n")).collect())  # bounded by the range of scores / step
    total, above = sum(r["n"] for r in grid), 0
    for r in sorted(grid, key=lambda r: -r["cell"]):
        above += r["n"]
        if above >= p.keep_trusted * total:
            return r["cell"] * p.step
    return None


def rate(docs: DataFrame, trusted: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base counts, ``score``,
    ``base_failed`` and ``kept``.  ``trusted`` has the doc_ids of target texts;
    repeated and null ids in it count once and not at all.

    The count pass shuffles the texts once, by id, to meet the trusted ids
    (their number grows with the labels, so they are never broadcast); the
    score pass reads them without a shuffle."""
    ids = (trusted.select("doc_id").where("doc_id is not null").distinct()
           .withColumn("trusted", part_of(F.col("doc_id"), p.held_out) != p.held_out - 1))
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    log_ratio = fit(marked, p)
    scored = keep(score(docs, log_ratio, p), "quality")
    limit = threshold(scored.join(ids.where("not trusted"), "doc_id"), p)
    base_failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    passes = F.col("score") >= F.lit(limit) if limit is not None else F.lit(True)
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & passes)


