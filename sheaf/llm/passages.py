"""Substring dedup by collinear chaining: passages that a document shares,
exactly or nearly, with an earlier one.

1. Seeds: of every ``window`` neighbouring runs of ``k`` words the one with the
   least hash, so an equal stretch of ``k + window - 1`` words gives both
   documents a common seed.  What a text says again is a seed of its own, by
   the number of times it was said before.
   Of the runs of ``near_k`` words, those whose hash is 0 modulo ``near_of`` are
   seeds too: edits at one word in five leave some of them.
   Likewise runs of ``min_words`` words, of ``exact_window`` neighbouring ones,
   so 50 equal words have such an exact seed; the first document that has it
   shares a passage of ``min_words`` there, whichever documents the short seeds
   point to.  Of 50 equal words or more that an earlier document has, all but
   ten at most at either end are thus in a result.
2. Most seeds are in one text only.  Chunks of texts ask which are not: each
   sends its distinct seeds once, as packed differences, to the bucket of
   their hash and gets back a bit for each.  Only seeds that two texts share
   become rows, and of these such as have others near them: a text's shared
   seeds lie close together in a passage, whichever documents they point to,
   and single ones are stock phrases.  Each points to its first document (smallest doc_id): a seed
   with n occurrences gives n - 1 anchors, never the pairs among them.  Origins
   are aggregated map-side first and joined back by sort-merge, which splits a
   frequent seed.
3. The anchors of a pair of documents are chained in order of both texts; a
   chain's score is ``k`` an anchor less ``gap`` a word stepped over in either,
   and a Fenwick tree over positions finds the best predecessor.  A chain has
   ``min_anchors`` anchors or an exact seed.
4. A chain is aligned on the texts: matching words are followed from its
   anchors in both directions, and after a difference of up to ``skip`` words
   where four words agree again.  A word that agrees scores 1, one that differs
   -``MISS``, and the best-scoring stretch stays.  What a passage's seeds gave
   to other documents is thus found again.  Passages of ``min_words`` words or
   more of which ``identity`` match are results; a stretch with fewer matches is
   split into its longest stretches that pass.  One that lies inside a passage
   shared with a smaller doc_id is no result of its own.

Passages always point to a smaller doc_id, so of a passage's occurrences the
one in the smallest doc_id is no result and stays when the others are cut.

Edge cases: nulls, empty and short texts have no seeds; rows without a doc_id
take no part; rows that repeat a doc_id are one document whose text is the
greatest of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.lm import pack, unpack
from sheaf.llm.tables import drop, keep, parts

_NEAR = np.uint64(0x8CB92BA72F3D8DD7)
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
GRAM = 4  # words that must agree after a difference
MISS = 2  # what a word that differs takes from a score
DROP = 8  # words that may differ on a diagonal before it is left


@dataclass(frozen=True)
class Params:
    k: int = 6
    window: int = 16
    near_k: int = 4        # of near copies with up to a fifth of their words replaced
    near_of: int = 2       # of so many runs of near_k words one, by its hash
    exact_window: int = 11  # of runs of min_words: one seed at least in 50 equal words
    gap: float = 0.1
    dense: int = 3         # shared seeds of a text within min_words to either side of one that counts
    min_anchors: int = 2
    min_words: int = 40   # so that a passage of 50 whose first and last words differ is found
    skip: int = 16
    identity: float = 0.8
    around: int = 128     # words beside a chain that are compared first
    chunk_words: int = 1 << 20
    bucket_chunks: int = 4   # chunks' worth of seeds that one task compares


def seeds(h: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the seeds of a text with word hashes ``h``."""
    if len(h) < p.k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = words.windows(h, p.k)
    if len(runs) <= p.window:
        at = np.array([int(runs.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(runs, p.window)
        at = view.argmin(axis=1) + np.arange(len(view))
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        at = _thinned(runs[at], at, p.window)
    return runs[at], at


def _thinned(found: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Of neighbouring positions with one hash (a word said over and over) the
    first, each ``window``-th and the last: still one in every window."""
    more = np.concatenate([[False], (found[1:] == found[:-1]) & (np.diff(at) == 1)])
    if not more.any():
        return at
    index = np.arange(len(at))
    start = np.maximum.accumulate(np.where(more, 0, index))
    last = np.concatenate([~more[1:], [True]])
    return at[((index - start) % window == 0) | last]


def exact_seeds(h: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the seeds among the runs of ``min_words`` words."""
    if len(h) < p.min_words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return seeds(h, replace(p, k=p.min_words, window=p.exact_window))


def near_seeds(h: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the runs of ``near_k`` words whose hash is 0 modulo
    ``near_of``: chosen by themselves, whatever was edited beside them."""
    if len(h) < p.near_k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    runs = words.mix(words.windows(h, p.near_k) ^ _NEAR)
    at = np.flatnonzero(runs % np.uint64(p.near_of) == 0)
    at = _thinned(runs[at], at, p.window)
    return runs[at], at


def _numbered(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``found`` (text by text) with the number of a hash's occurrences before
    it in its text mixed in, so that each is one seed of a text."""
    order = np.argsort(found, kind="stable")
    own, of = found[order], text[order]
    index = np.arange(len(own))
    before = np.empty(len(own), np.uint64)
    before[order] = index - np.maximum.accumulate(np.where(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])), index, 0)) if len(own) else index
    with np.errstate(over="ignore"):
        return np.where(before > 0, words.mix(found + before * _AGAIN), found)


_INVERSE = pow(words._BASE, -1, 1 << 64)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """``words.windows`` of every position with k words after it, by sums of
    powers: the same numbers in a few passes, whatever k is."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        back = np.full(n, _INVERSE, np.uint64)
        back[0] = 1
        sums = np.append(np.uint64(0), np.cumsum(h * np.multiply.accumulate(back)))
        return words.mix((sums[k:] - sums[:-k]) * words._powers(n)[k - 1:n] + np.uint64(k))


def _least(value: np.ndarray, window: int) -> np.ndarray:
    """The place of the least (first) value in each window of ``value``."""
    at = np.arange(len(value))
    size = 1
    while size < window:
        step = min(size, window - size)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    return at


def _block_minima(h: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``seeds`` of all texts of a block: (hash, place in ``h``)."""
    runs = _runs(h, k)
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    own = np.repeat(np.arange(len(count)), count)
    if not len(own):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = bounds[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    # texts apart by a window, so that none reaches into the next
    shifted = place + own * window
    value = np.full(int(shifted[-1]) + window, np.uint64(0xFFFFFFFFFFFFFFFF))
    back = np.zeros(len(value), np.int64)
    value[shifted], back[shifted] = runs[place], place
    first = place == bounds[own]
    whole = place + window - 1 + k <= bounds[own + 1]
    at = back[_least(value, window)[shifted[first | whole]]]
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    at = _thinned(runs[at], at, window)
    return runs[at], at


def _block_seeds(h: np.ndarray, bounds: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position, whether exact) of all seeds of a block's texts:
    ``seeds``, ``near_seeds`` and ``exact_seeds`` of each, numbered."""
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    runs = words.mix(_runs(h, p.near_k) ^ _NEAR)
    inside = np.arange(len(runs)) + p.near_k <= bounds[text[:len(runs)] + 1]
    at = np.flatnonzero(inside & (runs % np.uint64(p.near_of) == 0))
    at = _thinned(runs[at], at, p.window)
    kinds = [_block_minima(h, bounds, p.k, p.window), (runs[at], at), _block_minima(h, bounds, p.min_words, p.exact_window)]
    found = [_numbered(x, text[at]) for x, at in kinds]
    at = np.concatenate([at for _, at in kinds])
    return np.concatenate(found), text[at], at - bounds[text[at]], np.repeat([False, False, True], [len(x) for x in found])


CHUNK = "chunk long, doc_ids binary, sizes binary, words binary, codes binary"


def chunks(docs: DataFrame, p: Params) -> DataFrame:
    """The texts as words, many in a row: hashes of the distinct words and,
    for each word of the texts, its place among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, hashes, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            distinct, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (
                np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(sizes).astype("<u4").tobytes(), distinct.astype("<u8").tobytes(), pack(codes.astype(np.uint64))))],
                names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            own = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            for b in words.blocks(batch["text"]):
                ids.append(own[b.first:b.first + b.n_rows])
                sizes.append(np.diff(b.bounds))
                hashes.append(b.hashes(lower=True))
                n += len(hashes[-1])
                if n >= p.chunk_words:
                    yield flush()
                    number, ids, sizes, hashes, n = number + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, CHUNK)


def _chunk_seeds(row: dict, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position, whether exact) of the seeds of a chunk."""
    h = np.frombuffer(row["words"], "<u8")[unpack(row["codes"]).astype(np.int64)].astype(np.uint64)
    bounds = np.append(0, np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64)))
    return _block_seeds(h, bounds, p)


def _dense(text: np.ndarray, pos: np.ndarray, p: Params) -> np.ndarray:
    """Which of these seeds have ``dense`` of them, itself included, within
    ``min_words`` words of their text to either side."""
    key = (text << 32) + pos
    rising = np.sort(key)
    return np.searchsorted(rising, key + p.min_words, side="right") - np.searchsorted(rising, key - p.min_words) >= p.dense


KEY_BITS = 48  # of a seed, to ask whether it is shared; a wrong yes only costs a row


def _asked(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, whether each is there twice, the key of each seed)."""
    keys, place, n = np.unique(seed >> np.uint64(64 - KEY_BITS), return_inverse=True, return_counts=True)
    return keys, n > 1, place


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys."""
    return np.searchsorted(((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))


def shared(packed: DataFrame, buckets: int, p: Params) -> DataFrame:
    """(chunk, bucket, flags): for each key of a chunk whether another text has
    it too.  A chunk sends its distinct keys once, as packed differences."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, twice, _ = _asked(_chunk_seeds(row, p)[0])
                cuts = _cuts(keys, buckets)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                own = [slice(cuts[b], cuts[b + 1]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([pack(np.diff(keys[s], prepend=np.uint64(0))) for s in own], pa.binary()),
                                                  pa.array([np.packbits(twice[s]).tobytes() for s in own], pa.binary())], names=["bucket", "chunk", "keys", "twice"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in table["keys"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(k)) for t, k in zip(table["twice"], keys)]).astype(bool)
        all_keys = np.concatenate(keys)
        order = np.argsort(all_keys, kind="stable")
        again = np.diff(all_keys[order]) == 0
        twice[order[1:][again]] = twice[order[:-1][again]] = True
        bits = np.split(twice, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([table["chunk"], table["bucket"], pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], names=["chunk", "bucket", "flags"])

    return packed.mapInArrow(ask, "bucket int, chunk long, keys binary, twice binary").groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, flags binary")


def seed_rows(packed: DataFrame, flags: DataFrame, p: Params) -> DataFrame:
    """A row for each seed that two texts share and that has others near it;
    ``exact`` marks the runs of ``min_words`` words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            seed, text, pos, exact = _chunk_seeds(row, p)
            keys, _, place = _asked(seed)
            bits = [np.unpackbits(np.frombuffer(f, np.uint8)) for f in right.sort_by("bucket")["flags"].to_pylist()]
            cuts = np.diff(_cuts(keys, row["buckets"]))
            often = np.concatenate([np.empty(0, np.uint8), *[x[:n] for x, n in zip(bits, cuts[cuts > 0].tolist())]]).astype(bool)
            some = np.flatnonzero(often[place])
            some = some[exact[some] | _dense(text[some], pos[some], p)]
            doc_id = np.frombuffer(row["doc_ids"], "<i8")
            out.append(pa.table([words.as_long(seed[some]), pa.array(doc_id[text[some]].astype(np.int64)), pa.array(pos[some].astype(np.int32)), pa.array(exact[some])], names=["seed", "doc_id", "pos", "exact"]))
        return pa.concat_tables(out)

    return packed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(run, "seed long, doc_id long, pos int, exact boolean")


def anchors(docs: DataFrame, p: Params) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, other, pos, other_pos, exact): each shared seed with its place
    in the first document that has it; and the kept tables that this reads."""
    packed = keep(chunks(docs, p), "passages-chunks")
    buckets = max(parts(docs.sparkSession), packed.count() // p.bucket_chunks)
    flags = keep(shared(packed, buckets, p), "passages-shared")
    rows = keep(seed_rows(packed.withColumn("buckets", F.lit(buckets)), flags, p), "passages-seeds")
    drop(packed, flags)
    # a table of its own, so that the join below is one of two plain exchanges, which split a frequent seed
    origin = keep(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
                  .where("n > 1").select("seed", F.col("first.doc_id").alias("other"), F.col("first.pos").alias("other_pos")), "passages-origins")
    return (rows.join(origin.hint("merge"), "seed").where("doc_id <> other")
            .select("doc_id", "other", "pos", "other_pos", "exact")), [rows, origin]


def chains(pos: np.ndarray, other: np.ndarray, p: Params, exact: np.ndarray | None = None) -> list[np.ndarray]:
    """Anchors (indices, in order) of the chains of one pair of documents, best
    first; ``pos`` ascending, where it is equal ``other`` not ascending.  One of
    ``exact`` makes a chain by itself."""
    n = len(pos)
    rank = (np.unique(other, return_inverse=True)[1] + 1).tolist()
    lean = (p.gap * (pos + other)).tolist()
    value, arg = [0.0] * (n + 1), [-1] * (n + 1)  # Fenwick tree: the best score + lean up to a rank
    score, before = [0.0] * n, [-1] * n
    for i in range(n):
        best, j, r = 0.0, -1, rank[i] - 1
        while r:
            if arg[r] >= 0 and (j < 0 or value[r] > best):
                best, j = value[r], arg[r]
            r &= r - 1
        gain = best - lean[i] if j >= 0 else 0.0
        score[i], before[i] = (p.k + gain, j) if gain > 0 else (float(p.k), -1)
        new, r = score[i] + lean[i], rank[i]
        while r <= n:
            if arg[r] < 0 or new > value[r]:
                value[r], arg[r] = new, i
            r += r & -r
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if len(chain) >= p.min_anchors or exact is not None and exact[chain].any():
            out.append(np.array(chain[::-1]))
    return out


def _diagonal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """(whether the words agree, along the best-scoring common beginning without
    a gap; how many words that took)."""
    n, at, size, score, best, end, parts = min(len(a), len(b)), 0, 64, 0, 0, 0, []
    while at < n:
        stop = min(at + size, n)
        hit = a[at:stop] == b[at:stop]
        parts.append(hit)
        sums = score + np.cumsum(np.where(hit, 1, -MISS))
        low = np.flatnonzero(sums < np.maximum(np.maximum.accumulate(sums), best) - MISS * DROP)
        sums = sums[:low[0]] if len(low) else sums
        if len(sums) and sums.max() > best:
            best, end = int(sums.max()), at + int(sums.argmax()) + 1
        if len(low):
            return np.concatenate(parts)[:end], at + int(low[0]) + 1
        score, at, size = int(sums[-1]), stop, min(2 * size, 4096)
    return np.concatenate(parts)[:end] if parts else np.empty(0, bool), n


def follow(a: np.ndarray, b: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(words of a, words of b, agree) of each column of the best-scoring
    alignment of a beginning of ``a`` and one of ``b``, and how many words of
    ``a`` were looked at; it is given up where the score is ``skip`` differing
    words below its best."""
    i = j = score = best = n = kept = reach = 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(hit: np.ndarray, da: int = 1, db: int = 1) -> None:
        nonlocal i, j, score, n
        if len(hit):
            parts.append((np.full(len(hit), da), np.full(len(hit), db), hit))
            hits = int(np.count_nonzero(hit))
            i, j, n, score = i + da * len(hit), j + db * len(hit), n + len(hit), score + hits - MISS * (len(hit) - hits)

    while True:
        hit, looked = _diagonal(a[i:], b[j:])
        reach = max(reach, i + looked)
        add(hit)
        if score > best:
            best, kept = score, n
        if score < best - MISS * p.skip:
            break
        reach = max(reach, i + p.skip + GRAM)
        if len(a) - i < GRAM or len(b) - j < GRAM:
            break
        ga, gb = words.windows(a[i:i + p.skip + GRAM], GRAM), words.windows(b[j:j + p.skip + GRAM], GRAM)
        x, y = np.nonzero(ga[:, None] == gb[None, :])
        if not len(x):
            break
        first = int((x + y).argmin())
        x, y = int(x[first]), int(y[first])
        both = min(x, y)  # the words before that agree, on the old diagonal up to one place and on the new one after it
        old, new = a[i:i + both] == b[j:j + both], a[i + x - both:i + x] == b[j + y - both:j + y]
        turn = int((np.cumsum(np.append(0, old)) + np.append(np.cumsum(new[::-1])[::-1], 0)).argmax())
        add(old[:turn])
        add(np.zeros(max(x, y) - both, bool), int(x > y), int(y > x))
        add(new[turn:])
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), reach
    da, db, hit = (np.concatenate(c)[:kept] for c in zip(*parts))
    return da, db, hit, reach


def _passing(a: np.ndarray, b: np.ndarray, hit: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """The columns (begin, end) of an alignment's passages: the whole of it,
    or else the longest stretch that passes and those on its two sides."""
    out, todo = [], [(0, len(hit))]
    while todo:
        s, e = todo.pop()
        at = np.flatnonzero(hit[s:e])
        if not len(at):
            continue
        s, e = s + int(at[0]), s + int(at[-1]) + 1
        if a[e] - a[s] < p.min_words:
            continue
        if len(at) >= p.identity * max(a[e] - a[s], b[e] - b[s]):
            out.append((s, e))
            continue
        sums = np.append(0, np.cumsum(np.where(hit[s:e], 1 - p.identity, -p.identity)))
        begin = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-9)  # the first with no greater sum
        v = int((np.arange(len(sums)) - begin).argmax())
        u = int(begin[v])
        if v - u >= p.min_words:
            todo += [(s, s + u), (s + u, s + v), (s + v, e)]
    return sorted(out)


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, other: np.ndarray, p: Params) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, matches) along a chain."""
    return _align(a, b, pos, other, p)[0]


def _align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, other: np.ndarray, p: Params) -> tuple[list[tuple[int, int, int, int, int]], bool, bool]:
    """``align``, and whether that looked at the first and the last word of ``a``
    or beyond."""
    out, seen, first, last = [], np.zeros(len(pos), bool), False, False
    for k, (x, y) in enumerate(zip(pos.tolist(), other.tolist())):
        if seen[k]:  # agrees in an alignment already split into its passages
            continue
        left, right = follow(a[:x][::-1], b[:y][::-1], p), follow(a[x:], b[y:], p)
        first, last = first or left[3] >= x, last or right[3] >= len(a) - x
        da, db, hit = (np.concatenate([l[::-1], r]) for l, r in zip(left[:3], right[:3]))
        at = x - int(left[0].sum()) + np.append(0, np.cumsum(da))
        to = y - int(left[1].sum()) + np.append(0, np.cumsum(db))
        for s, e in _passing(at, to, hit, p):
            out.append((int(at[s]), int(at[e]), int(to[s]), int(to[e]), int(np.count_nonzero(hit[s:e]))))
        if hit.any():
            mine, theirs = at[:-1][hit], to[:-1][hit]
            near = np.minimum(np.searchsorted(mine, pos), len(mine) - 1)
            seen |= (mine[near] == pos) & (theirs[near] == other)
    return sorted(set(out)), first, last


CLIPPED = "doc_id long, other long, base array<int>, last array<boolean>, part array<binary>, of array<int>, at array<array<int>>, to array<array<int>>"


def _clipped(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The parts of a text within ``around`` words of a pair's chains, instead
    of the text: ``base`` is a part's first word, ``last`` whether it ends with
    the text, ``of`` each chain's part."""
    for batch in batches:
        out = []
        ids, others, at, to = (batch[c].to_pylist() for c in ("doc_id", "other", "at", "to"))
        for b in words.blocks(batch["text"]):
            for i, s in b.rows():
                n = s.stop - s.start
                # anchors beyond the text are of another one of its doc_id
                kept = [[(x, y) for x, y in zip(*c) if x < n] for c in zip(at[i], to[i])]
                kept = sorted([c for c in kept if c], key=lambda c: c[0])
                base, end, of = [], [], []
                for c in kept:
                    low, high = max(0, c[0][0] - p.around), min(n, c[-1][0] + p.around)
                    if not base or low > end[-1]:
                        base.append(low)
                        end.append(high)
                    end[-1] = max(end[-1], high)
                    of.append(len(base) - 1)
                part = [b.data[b.starts[s.start + x]:b.ends[s.start + y - 1]].tobytes() for x, y in zip(base, end)]
                out.append((ids[i], others[i], base, [y == n for y in end], part, of, [[x for x, _ in c] for c in kept], [[y for _, y in c] for c in kept]))
        ints = pa.list_(pa.int32())
        kinds = (pa.int64(), pa.int64(), ints, pa.list_(pa.bool_()), pa.list_(pa.binary()), ints, pa.list_(ints), pa.list_(ints))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in CLIPPED.split(", ")])


def _hashed(part: pa.Array) -> list[list[np.ndarray]]:
    """The word hashes of each part of each row."""
    flat = [h[s] for b in words.blocks(part.flatten()) for h in [b.hashes(lower=True)] for _, s in b.rows()]
    ends = np.append(0, np.cumsum(part.value_lengths().to_numpy())).tolist()
    return [flat[x:y] for x, y in zip(ends, ends[1:])]


def _able(a: np.ndarray, sorted_other: np.ndarray, pos: np.ndarray, begins: bool, ends: bool, p: Params) -> bool:
    """Whether an alignment through anchors at ``pos`` (ascending) may hold a
    passage or look beyond an end of ``a`` that is no end of its text (all but
    ``begins``, ``ends``).  A word of ``a`` that the other text has nowhere
    never agrees, so counting all others as agreeing bounds every score from
    above: it tells how far an alignment reaches, and whether any stretch there
    has matches enough.  A no is certain."""
    if not len(sorted_other):
        return False
    agree = sorted_other[np.minimum(np.searchsorted(sorted_other, a), len(sorted_other) - 1)] == a
    sums = np.append(0, np.cumsum(np.where(agree, 1, -MISS)))
    # given up ``skip`` misses below the best, after at most one more difference and a look along its diagonal
    drop = MISS * (2 * p.skip + GRAM + DROP + 1)
    right = np.flatnonzero(sums[pos[-1]:] < sums[pos].min() - drop)
    left = np.flatnonzero(sums[:pos[0] + 1] > sums[pos].max() + drop)
    margin = p.skip + GRAM  # words after a stretch that are looked at for a run that agrees
    low, high = (int(left[-1]) if len(left) else 0), (int(pos[-1] + right[0]) if len(right) else len(a))
    if low <= margin and not begins or high >= len(a) - margin and not ends:
        return True
    over = np.append(0, np.cumsum(agree[low:high] - p.identity))
    return len(over) > p.min_words and bool((over[p.min_words:] >= np.minimum.accumulate(over)[:-p.min_words] - 1e-9).any())


FOUND = "doc_id long, other_doc_id long, start int, end int, other_start int, other_end int, matches int"


def _compared(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """The passages of each pair, or one row without any where an alignment
    came to an end of a part that is no end of the text."""
    before, far, sorted_far = None, None, None
    for batch in batches:
        out = []
        columns = [batch[c.split()[0]].to_pylist() for c in CLIPPED.split(", ") if c.split()[0] != "part"]
        own = _hashed(batch["part"])
        for row, (d, o, base, last, of, at, to) in enumerate(zip(*columns)):
            if o != before:
                before, far = o, words.block_of(batch["other_text"][row].as_py().encode()).hashes(lower=True)
                sorted_far = np.unique(far)
            found, again = set(), False
            for k, (a, low, end) in enumerate(zip(own[row], base, last)):
                mine = sorted({c for j, x, y in zip(of, at, to) if j == k for c in zip(x, y)})
                pos, other = np.array([x for x, _ in mine], np.int64) - low, np.array([y for _, y in mine], np.int64)
                if not _able(a, sorted_far, pos, low == 0, end, p):
                    continue
                spans, first, beyond = _align(a, far, pos, other, p)
                again = again or first and low > 0 or beyond and not end
                found |= {(x + low, y + low, *rest) for x, y, *rest in spans}
            out += [(d, o, None, None, None, None, None)] if again else [(d, o, *x) for x in sorted(found)]
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


PASSAGE = "doc_id long, other_doc_id long, start int, end int, other_start int, other_end int, matches int"


def passages(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """A row for each passage that ``doc_id`` shares with ``other_doc_id``, a
    smaller one: ``start`` and ``end`` count words (end excluded)."""
    found, read = anchors(docs, p)
    pairs = found.groupBy("doc_id", "other").agg(F.collect_list(F.struct("pos", "other_pos", "exact")).alias("at"), F.max("exact").alias("whole"))
    pairs = pairs.where((F.size("at") >= p.min_anchors) | F.col("whole")).drop("whole")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, other, at, to = [], [], [], []  # a row a pair, a list a chain
            for i, (d, o, own) in enumerate(zip(batch["doc_id"].to_pylist(), batch["other"].to_pylist(), batch["at"])):
                flat = own.values
                x, y = flat.field("pos").to_numpy().astype(np.int64), flat.field("other_pos").to_numpy().astype(np.int64)
                whole = flat.field("exact").to_numpy(zero_copy_only=False)
                order = np.lexsort((~whole, -y, x))
                order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))]  # seeds of several kinds at one place are one anchor
                x, y, whole = x[order], y[order], whole[order]
                found = chains(x, y, p, whole)
                if found:
                    doc.append(d)
                    other.append(o)
                    at.append([x[c] for c in found])
                    to.append([y[c] for c in found])
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(other, pa.int64()), pa.array(at, kind), pa.array(to, kind)], names=["doc_id", "other", "at", "to"])

    chained = keep(pairs.mapInArrow(chain, "doc_id long, other long, at array<array<int>>, to array<array<int>>"), "passages-chains")
    drop(*read)
    wanted = chained.select("doc_id").unionByName(chained.select(F.col("other").alias("doc_id"))).distinct()
    # not kept: both sides below read one exchange of the texts by their document
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))

    far = texts.select(F.col("doc_id").alias("other"), F.col("text").alias("other_text"))
    parts_ = chained.join(texts, "doc_id").mapInArrow(lambda x: _clipped(x, p), CLIPPED)
    near = keep(parts_.join(far, "other").select(*[c.split()[0] for c in CLIPPED.split(", ")], "other_text").mapInArrow(lambda x: _compared(x, p), FOUND), "passages-near")
    # what goes on beyond its parts is aligned on whole texts
    whole = chained.join(near.where("matches is null").select("doc_id", F.col("other_doc_id").alias("other")).hint("merge"), ["doc_id", "other"], "left_semi")
    whole = whole.join(texts, "doc_id").select("doc_id", "other", F.array(F.lit(0)).alias("base"), F.array(F.lit(True)).alias("last"), F.array(F.col("text").cast("binary")).alias("part"),
                                               F.transform("at", lambda c: F.lit(0)).alias("of"), "at", "to")
    found = near.where("matches is not null").unionByName(whole.join(far, "other").select(*[c.split()[0] for c in CLIPPED.split(", ")], "other_text").mapInArrow(lambda x: _compared(x, p), FOUND))
    rows = found.groupBy("doc_id").agg(F.collect_set(F.struct(*[x.split()[0] for x in PASSAGE.split(", ")][1:])).alias("rows"))
    first = F.expr("filter(rows, r -> not exists(rows, q -> q.other_doc_id < r.other_doc_id and q.start <= r.start and q.`end` >= r.`end`))")
    return rows.select("doc_id", F.inline(first))


def _without(raw: bytes, spans: list[dict]) -> bytes:
    b, kept, at = words.block_of(raw), [], 0
    for s in spans:
        if s["end"] > len(b.starts):  # of another text of the same doc_id
            continue
        begin = int(b.starts[s["start"]])
        if begin > at:
            kept.append(raw[at:begin])
        at = max(at, int(b.starts[s["end"]]) if s["end"] < len(b.starts) else len(raw))
    return b"".join([*kept, raw[at:]])


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages in ``found`` (doc_id, start, end); the
    white space after a passage goes with it.  Rows without a passage are as
    they were; a text that was one passage is empty."""
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    marked = docs.join(spans.hint("merge"), F.col("doc_id") == F.col("__id"), "left").select(*docs.columns, "__spans")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, own = batch.columns[:-1], batch.column("__spans")
            if own.null_count < len(own):
                text = [t if s is None or t is None else _without(t.encode(), s).decode() for t, s in zip(batch["text"].to_pylist(), own.to_pylist())]
                columns[at] = pa.array(text, batch["text"].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return marked.mapInArrow(run, docs.schema)
