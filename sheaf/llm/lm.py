"""Language-model scoring by deleted interpolation.

The probability of a word after another is a mixture of its bigram, unigram
and uniform estimates,

    l2[b] c(h w) / c(h)  +  l1[b] c(w) / N  +  l0[b] / (V + 1),

with weights by the frequency bucket b of the context (the binary logarithm of
c(h)).  The weights are learned by expectation-maximisation on held-out counts:
each training token is predicted from counts without its own document.  A
text's tokens are its lower-cased words and one end; the end also is the
context of the first word.

Counts of all n-grams of the corpus are exchanged in packed form.  Texts are
written once in chunks of about ``chunk_bytes``; a chunk sends each distinct
n-gram with its count to the bucket of its hash (pre-aggregated, so a frequent
word is one entry a chunk), a bucket adds up and answers with the totals, and a
chunk joins the answers with its text.  Buckets and chunks are about equally
large whatever the size of the corpus; nothing but sums over weights' cells
(frequency bucket x two rounded logarithms) reaches the driver.

Edge cases: null and empty texts are the end alone; repeated rows count as
often as they occur; without training texts the counts are 0, the weights of
the bigram and unigram estimates have no effect and all scores are uniform; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words
from sheaf.llm.tables import keep

END = np.uint64(0x6A09E667F3BCC909)


@dataclass(frozen=True)
class Params:
    chunk_bytes: int = 8 << 20
    min_buckets: int = 64
    grid: int = 4            # cells an octave of the estimates, for the weights
    rounds: int = 60
    prior: float = 1.0       # tokens' worth of equal weights in each frequency bucket


def pack(x: np.ndarray) -> bytes:
    """uint64 numbers, small or of small differences, in few bytes."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, offsets binary, text binary"


def chunks(docs: DataFrame, p: Params) -> DataFrame:
    """Texts of (doc_id, text, train), many in a row, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        number, ids, train, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
            raw = zstandard.ZstdCompressor(level=9).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
                                               pa.array([pack(lengths)], pa.binary()), pa.array([raw], pa.binary())], names=["chunk", "doc_ids", "train", "offsets", "text"])

        for batch in batches:
            data, at = words.bytes_of(batch["text"])
            for i, (doc_id, own) in enumerate(zip(batch["doc_id"].to_pylist(), batch["train"].to_pylist())):
                ids.append(doc_id)
                train.append(own)
                texts.append(data[at[i]:at[i + 1]].tobytes())
                size += len(texts[-1]) + 64
                if size >= p.chunk_bytes:
                    yield flush()
                    number, ids, train, texts, size = number + 1, [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(run, CHUNK)


@dataclass
class Tokens:
    """The n-grams of a chunk: hashes token by token, and rows' bounds."""

    bounds: np.ndarray
    uni: np.ndarray
    bi: np.ndarray


def tokens(offsets: bytes, text: bytes) -> Tokens:
    import zstandard
    at = unpack(offsets).astype(np.int64)
    raw = zstandard.ZstdDecompressor().decompress(text)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)])
    uni, counts = [], []
    for b in words.blocks(column):
        h, n = b.hashes(lower=True), np.diff(b.bounds)
        uni.append(np.insert(h, b.bounds[1:], END))
        counts.append(n + 1)
    uni = np.concatenate(uni)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    before = np.concatenate([[END], uni[:-1]])  # a row's last token is the end, the next row's first context
    with np.errstate(over="ignore"):
        return Tokens(bounds, uni, words.mix(before * np.uint64(0x9E3779B97F4A7C15) + uni))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so that sorted keys stay sorted bucket by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


REQUEST = "bucket int, chunk long, gram int, keys binary, counts binary"


def requests(packed: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket its distinct n-grams and their counts in
    training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t = tokens(batch["offsets"][r].as_py(), batch["text"][r].as_py())
                train = np.repeat(np.array(batch["train"][r].as_py(), bool), np.diff(t.bounds))
                out = []
                for gram, all_keys in ((1, t.uni), (2, t.bi)):
                    order = np.argsort(all_keys)
                    sorted_ = all_keys[order]
                    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                    keys, counts = sorted_[first], np.add.reduceat(train[order].astype(np.uint64), first)
                    cuts = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[b], cuts[b + 1])
                        out.append((b, batch["chunk"][r].as_py(), gram, pack(np.diff(keys[own], prepend=np.uint64(0))), pack(counts[own])))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "chunk", "gram", "keys", "counts"])

    return packed.mapInArrow(run, REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, gram, bucket, totals): the corpus counts of each request's keys."""
    def run(table: pa.Table) -> pa.Table:
        out = []
        for gram in (1, 2):
            own = table.filter(pa.array(np.array(table["gram"]) == gram))
            if not own.num_rows:
                continue
            keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in own["keys"]]
            all_keys, counts = np.concatenate(keys), np.concatenate([unpack(c.as_py()) for c in own["counts"]])
            order = np.argsort(all_keys)
            sorted_ = all_keys[order]
            first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
            total = np.empty(len(order), np.uint64)
            total[order] = np.add.reduceat(counts[order], np.flatnonzero(first))[np.cumsum(first) - 1]
            at = np.cumsum([0, *map(len, keys)])
            out += [(c, gram, b, pack(total[at[i]:at[i + 1]])) for i, (c, b) in enumerate(zip(own["chunk"].to_pylist(), own["bucket"].to_pylist()))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["chunk", "gram", "bucket", "totals"])

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, gram int, bucket int, totals binary")


def _own(inverse: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each token how often its n-gram is in its row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, back, n = np.unique(row * (int(inverse.max()) + 1) + inverse, return_inverse=True, return_counts=True)
    return n[back]


COUNTED = "doc_ids array<long>, train array<boolean>, lengths array<long>, counts binary"


def counted(packed: DataFrame, answered: DataFrame) -> DataFrame:
    """A row a chunk: for each token of its texts c(w), c(h w), and how many of
    them are of the text itself."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in range(left.num_rows):
            t = tokens(left["offsets"][r].as_py(), left["text"][r].as_py())
            columns = []
            for gram, keys in ((1, t.uni), (2, t.bi)):
                own = right.filter(pa.array(np.array(right["gram"]) == gram)).sort_by("bucket")
                total = np.concatenate([unpack(x.as_py()) for x in own["totals"]])
                inverse = np.unique(keys, return_inverse=True)[1]
                columns += [total[inverse], _own(inverse, t.bounds).astype(np.uint64)]
            out.append((left["doc_ids"][r].as_py(), left["train"][r].as_py(), np.diff(t.bounds).tolist(), pack(np.concatenate(columns))))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["doc_ids", "train", "lengths", "counts"])

    return packed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, COUNTED)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bool, tuple[np.ndarray, ...]]]:
    """(doc_id, train, (c(w), own c(w), c(h w), own c(h w), c(h), own c(h)) of
    its tokens) for each text; the last token, the end, is the context of the
    first."""
    for ids, train, lengths, raw in zip(*(batch[c] for c in ("doc_ids", "train", "lengths", "counts"))):
        table = unpack(raw.as_py()).astype(np.float64).reshape(4, -1)
        ends = np.cumsum(lengths.as_py())
        for doc_id, own, n, end in zip(ids.as_py(), train.as_py(), lengths.as_py(), ends):
            w, own_w, hw, own_hw = table[:, end - n:end]
            yield doc_id, own, (w, own_w, hw, own_hw, np.concatenate([w[-1:], w[:-1]]), np.concatenate([own_w[-1:], own_w[:-1]]))


def frequency_bucket(h: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the binary logarithm of the count."""
    return np.where(h > 0, 1 + np.floor(np.log2(np.maximum(h, 1))), 0).astype(np.int64)


NONE = -10_000  # the cell of an estimate of 0


def statistics(rows: DataFrame, p: Params) -> DataFrame:
    """(bucket, bigram, unigram, n, types): training tokens by frequency bucket
    and rounded logarithms of their held-out estimates (the unigram's without
    division by N); ``types`` adds up to the number of distinct tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int, int], list[float]] = {}
        for batch in batches:
            for _, train, (w, own_w, hw, own_hw, h, own_h) in _texts(batch):
                if not train:
                    continue
                context = h - own_h
                grid = np.full((3, len(w)), NONE, np.int64)
                grid[0] = frequency_bucket(context)
                ok = hw > own_hw
                grid[1, ok] = np.round(p.grid * np.log2((hw - own_hw)[ok] / context[ok]))
                ok = w > own_w
                grid[2, ok] = np.round(p.grid * np.log2((w - own_w)[ok]))
                found, back, n = np.unique((grid[0] * 20_011 + grid[1] + 10_000) * 20_011 + grid[2] + 10_000, return_inverse=True, return_counts=True)
                types = np.bincount(back, 1 / w)
                for cell, c, v in zip(found.tolist(), n.tolist(), types.tolist()):
                    own = cells.setdefault(cell, [0, 0.0])
                    own[0] += c
                    own[1] += v
        keys = list(cells)
        rest, uni = zip(*[divmod(k, 20_011) for k in keys]) if keys else ((), ())
        bucket, bi = zip(*[divmod(k, 20_011) for k in rest]) if keys else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([x - 10_000 for x in bi], pa.int64()), pa.array([x - 10_000 for x in uni], pa.int64()),
                                          pa.array([cells[k][0] for k in keys], pa.int64()), pa.array([cells[k][1] for k in keys], pa.float64())],
                                         names=["bucket", "bigram", "unigram", "n", "types"])

    return (rows.mapInArrow(run, "bucket long, bigram long, unigram long, n long, types double")
            .groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n"), F.sum("types").alias("types")))


@dataclass(frozen=True)
class Model:
    tokens: int            # N
    types: int             # V
    weights: np.ndarray    # (frequency bucket, [bigram, unigram, uniform])


def learn(bucket: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, n: np.ndarray, types: np.ndarray, p: Params = Params()) -> Model:
    """Expectation-maximisation over the cells of ``statistics``."""
    total, kinds = int(n.sum()), round(float(types.sum()))
    size = int(bucket.max(initial=0)) + 2
    each = np.stack([np.where(bigram == NONE, 0, 2.0 ** (np.where(bigram == NONE, 0, bigram) / p.grid)),
                     np.where(unigram == NONE, 0, 2.0 ** (np.where(unigram == NONE, 0, unigram) / p.grid)) / max(1, total),
                     np.full(len(n), 1 / (kinds + 1))], 1)
    weights = np.full((size, 3), 1 / 3)
    for _ in range(p.rounds):
        joint = weights[bucket] * each
        share = joint / joint.sum(axis=1, keepdims=True) * n[:, None]
        new = np.stack([np.bincount(bucket, share[:, j], minlength=size) for j in range(3)], 1) + p.prior / 3
        weights = new / new.sum(axis=1, keepdims=True)
    return Model(total, kinds, weights)


def score(rows: DataFrame, m: Model) -> DataFrame:
    """Base and model score of each text in ``counted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, trained, size, known, base, value = [], [], [], [], [], []
            for doc_id, train, (w, _, hw, _, h, _) in _texts(batch):
                ids.append(doc_id)
                trained.append(train)
                size.append(len(w))
                known.append(int((w > 0).sum()))
                base.append(float(np.log10((w + 1) / (m.tokens + m.types + 1)).sum()))
                l2, l1, l0 = m.weights[np.minimum(frequency_bucket(h), len(m.weights) - 1)].T
                seen = h > 0
                bigram = np.divide(hw, h, out=np.zeros_like(h), where=seen)
                part = l2 * bigram + l1 * w / max(1, m.tokens) + l0 / (m.types + 1)
                # an unseen context says nothing: its bigram weight goes to the others
                part = np.where(seen, part, part / (1 - l2))
                value.append(float(np.log10(part).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trained, pa.bool_()), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64())],
                                             names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, train): n_tokens, n_known,
    train_tokens, base_score and score (log10 of the text's probability); the
    model learns from the rows with ``train``."""
    packed = keep(chunks(docs, p), "lm-chunks")
    buckets = max(p.min_buckets, packed.count())
    rows = keep(counted(packed, answers(requests(packed, buckets))), "lm-counts")
    cells = statistics(rows, p).toPandas()  # frequency buckets x rounded logarithms
    m = learn(*(cells[c].to_numpy() for c in ("bucket", "bigram", "unigram", "n", "types")), p)
    return score(rows, m).withColumn("train_tokens", F.lit(m.tokens).cast("long"))
