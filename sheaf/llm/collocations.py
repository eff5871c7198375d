"""Phrase collocations: phrases of 2 to 4 words that are said more often than
their parts would make them, by exact counts per language.

Texts, A-Z in lower case, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
these at spaces and tabs into words; a phrase lies inside one piece.

1. Texts are written once in chunks of about ``chunk_bytes`` of one language: a
   dictionary of distinct words with counts, and the texts as numbers into it.
2. Dictionaries are added up to the words said ``least`` times or more; these
   get dense numbers and are joined back to the chunks, whose texts become runs
   of word numbers, broken where a piece ends or a word is rarer.
3. Each chunk counts its pairs of words in a counting quotient filter
   (``quotient.py``), cut into shards by the first bits of the permuted keys;
   the filters of a shard are merged.  A shard answers each chunk with one bit
   for each of its pairs: frequent or not.
4. The same for phrases of 3 and 4 words, of frequent pairs alone: a phrase said
   ``least`` times has no pair said less often, so nothing is lost.

A frequent word or phrase is one entry a chunk, and permuted keys spread evenly,
so no shard is hot; ``shards`` follows the number of words.  Then joins of
phrases with their parts give the scores.  All counts are exact; products are
decimals.

Edge cases: null languages count as ``und``, null texts as empty; repeated rows
count each; an empty table, or one without a frequent phrase, gives no rows.
A text above ``chunk_bytes`` is a chunk of its own.  Ties in rank go by score,
count and phrase, which differ.  Other columns are not read.  There may be 2^32
words said ``least`` times at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.llm import words
from sheaf.llm.quotient import Filter, merge
from sheaf.llm.tables import keep, parts

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _ENDS.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass(frozen=True)
class Params:
    least: int = 30
    scale: int = 2_000_000
    cover: int = 80          # percent of a phrase's count that a longer one has to have to replace it
    top: int = 2000
    chunk_bytes: int = 8 << 20
    held_chunks: int = 4     # chunks' worth of text a task holds, over all languages
    shard_words: int = 1 << 20


def _pack(x: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _spoken(b: words.Block) -> tuple[pa.Array, np.ndarray]:
    """(words, whether a piece begins with each) of a block."""
    sizes = b.ends - b.starts
    found = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(_LOWER[b.data[b.inside]]))
    marks = np.concatenate([[0], np.cumsum(_ENDS[b.data])])
    begins = np.ones(len(sizes), bool)
    begins[1:] = marks[b.starts[1:]] > marks[b.ends[:-1]]
    first = b.bounds[:-1]
    begins[first[first < len(sizes)]] = True
    return found, begins


CHUNK = "chunk long, lang string, n long, dictionary array<string>, counts array<long>, text binary"


def chunks(docs: DataFrame, p: Params) -> DataFrame:
    """Texts of (text, lang) by language: numbers into ``dictionary`` from 1, 0
    where a piece begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            found, begins = zip(*held.pop(lang))
            del size[lang]
            encoded = pa.concat_arrays(found).dictionary_encode()
            at, begins = encoded.indices.to_numpy().astype(np.int64), np.concatenate(begins)
            counts = np.bincount(at, minlength=len(encoded.dictionary))
            text = np.insert(at + 1, np.flatnonzero(begins), 0)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([lang]), pa.array([len(at)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), encoded.dictionary),
                                               pa.array([counts], pa.list_(pa.int64())), pa.array([_pack(text)], pa.binary())], names=[c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            lang = batch["lang"].fill_null("und").dictionary_encode()
            of = lang.indices.to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                for b in words.blocks(batch["text"].take(pa.array(np.flatnonzero(of == i))), separators=_APART):
                    if len(b.starts):
                        held.setdefault(name, []).append(_spoken(b))
                        size[name] = size.get(name, 0) + len(b.data)
                        if size[name] >= p.chunk_bytes:
                            yield flush(name)
                        elif sum(size.values()) >= p.held_chunks * p.chunk_bytes:
                            yield flush(max(size, key=size.get))
        for name in list(held):
            yield flush(name)

    return docs.select("text", "lang").mapInArrow(run, CHUNK)


def vocabulary(packed: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, int]:
    """((lang, word, f, id) of the frequent words, the dictionaries' rows, the
    number of words): ids from 1, without gaps."""
    spark = packed.sparkSession
    own = (packed.select("chunk", "lang", F.posexplode(F.arrays_zip("dictionary", "counts")).alias("at", "entry"))
           .select("chunk", "lang", "at", F.col("entry.dictionary").alias("word"), F.col("entry.counts").alias("n")))
    found = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= p.least)
    found = keep(found.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "collocations-words")
    size = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [], 0
    for part in sorted(size):
        before.append((part, total))
        total += size[part]
    offsets = spark.createDataFrame(before, "part int, before long")
    numbered = found.join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("before") + F.col("at") + 1).alias("id"))
    return numbered, own, total


def encoded(packed: DataFrame, own: DataFrame, numbered: DataFrame) -> DataFrame:
    """(chunk, text): word numbers, 0 for a break."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in range(left.num_rows):
            ids = np.zeros(len(left["dictionary"][r]) + 1, np.uint32)
            ids[right["at"].to_numpy() + 1] = right["id"].to_numpy()
            text = ids[_unpack(left["text"][r].as_py())]
            text = text[(text > 0) | (np.append(0, text[:-1]) > 0)]
            out.append((left["chunk"][r].as_py(), _pack(text)))
        return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["chunk", "text"])

    ids = own.join(numbered.select("lang", "word", "id").hint("merge"), ["lang", "word"]).select(F.col("chunk").alias("own"), "at", "id")
    return packed.select("chunk", "dictionary", "text").groupBy("chunk").cogroup(ids.groupBy("own")).applyInArrow(run, "chunk long, text binary")


def _pairs(text: np.ndarray) -> np.ndarray:
    """Where a pair of words begins."""
    return np.flatnonzero((text[:-1] > 0) & (text[1:] > 0)) if len(text) else np.empty(0, np.int64)


@dataclass(frozen=True)
class Layout:
    """How phrases of word numbers become keys."""

    bits: int    # of a word number
    top: int     # of the shard's number

    def width(self, n: int) -> int:
        return self.bits if n == 2 else 2 * self.bits

    def top_of(self, n: int) -> int:
        return min(self.top, self.width(n))

    def counted(self, text: np.ndarray, at: np.ndarray, n: int) -> Filter:
        """The phrases of ``n`` words at the places ``at``."""
        text = text.astype(np.uint64)
        b = np.uint64(self.bits)
        if n == 2:
            return Filter.of(text[at], text[at + 1], self.bits)
        last = text[at + 3] if n == 4 else np.uint64(0)
        return Filter.of(text[at] << b | text[at + 1], text[at + 2] << b | last, 2 * self.bits)

    def ids(self, f: Filter, n: int) -> np.ndarray:
        """(phrases, n): the word numbers of a filter's keys."""
        left, right = f.keys()
        if n == 2:
            return np.stack([left, right], 1)
        b, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        return np.stack([left >> b, left & low, right >> b, right & low][:n], 1)


PIECE = "gram int, shard int, chunk long, raw binary"


def _pieces(chunk: int, filters: list[tuple[int, Filter]], layout: Layout) -> list[tuple]:
    return [(n, shard, chunk, piece.packed(layout.top_of(n))) for n, f in filters for shard, piece in f.shards(layout.top_of(n))]


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


_PIECE = ([pa.int32(), pa.int32(), pa.int64(), pa.binary()], ["gram", "shard", "chunk", "raw"])


def pairs(texts: DataFrame, layout: Layout) -> DataFrame:
    """The filters of each chunk's pairs of words, by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch["chunk"].to_pylist(), batch["text"]):
                text = _unpack(raw.as_py())
                rows = _pieces(chunk, [(2, layout.counted(text, _pairs(text), 2))], layout)
                yield pa.RecordBatch.from_arrays(_columns(rows, _PIECE[0]), names=_PIECE[1])

    return texts.mapInArrow(run, PIECE)


def longer(texts: DataFrame, flags: DataFrame, layout: Layout) -> DataFrame:
    """The filters of each chunk's phrases of 3 and 4 words whose pairs are
    all frequent."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for r in range(left.num_rows):
            text = _unpack(left["text"][r].as_py())
            at = _pairs(text)
            known = layout.counted(text, at, 2)
            own = {s: f for s, f in zip(right["shard"].to_pylist(), right["flags"].to_pylist())}
            often = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(own[s], np.uint8), count=len(piece)).astype(bool) for s, piece in known.shards(layout.top_of(2))]])
            good = np.zeros(len(text) + 2, bool)  # a frequent pair begins here
            good[at[often[known.find(text[at], text[at + 1])]]] = True
            three = good[:-2] & good[1:-1]
            rows += _pieces(left["chunk"][r].as_py(), [(3, layout.counted(text, np.flatnonzero(three), 3)), (4, layout.counted(text, np.flatnonzero(three & good[2:]), 4))], layout)
        return pa.table(_columns(rows, _PIECE[0]), names=_PIECE[1])

    return texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(run, PIECE)


MERGED = "gram int, ids array<long>, f long, shard int, chunk long, flags binary"


def merged(pieces: DataFrame, layout: Layout, least: int, answer: bool) -> DataFrame:
    """The frequent phrases (gram, ids, f) of all chunks and, where ``answer``,
    a row (shard, chunk, flags) for each piece."""
    def run(table: pa.Table) -> pa.Table:
        n, shard = table["gram"][0].as_py(), table["shard"][0].as_py()
        own = [Filter.unpacked(raw.as_py(), shard, layout.top_of(n), layout.width(n)) for raw in table["raw"]]
        total, places = merge(own)
        often = total.count >= least
        some = np.flatnonzero(often)
        ids = layout.ids(Filter(total.width, total.left[some], total.right[some], total.count[some]), n).astype(np.int64)
        parts_ = [pa.table([pa.array(np.full(len(some), n, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * n, pa.int32()), pa.array(ids.ravel())),
                            pa.array(total.count[some].astype(np.int64)), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary())], names=_MERGED)]
        if answer:
            m = table.num_rows
            parts_.append(pa.table([pa.array(np.full(m, n, np.int32)), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.int64()), pa.array(np.full(m, shard, np.int32)), table["chunk"],
                                    pa.array([np.packbits(often[x]).tobytes() for x in places], pa.binary())], names=_MERGED))
        return pa.concat_tables(parts_)

    return pieces.groupBy("gram", "shard").applyInArrow(run, MERGED)


_MERGED = [c.split()[0] for c in MERGED.split(", ")]


def scores(phrases: DataFrame, numbered: DataFrame, p: Params) -> DataFrame:
    """(ids, a, l, r, score) of the phrases (gram, ids, f) that no longer one
    covers, by their weakest cut."""
    single = numbered.select(F.array("id").alias("ids"), "f")
    known = single.unionByName(phrases.select("ids", "f"))
    cut = phrases.select("gram", "ids", F.col("f").alias("a"), F.explode(F.expr("sequence(1, gram - 1)")).alias("k"))
    cut = cut.withColumn("first", F.expr("slice(ids, 1, k)")).withColumn("rest", F.expr("slice(ids, k + 1, gram - k)"))
    cut = cut.join(known.select(F.col("ids").alias("first"), F.col("f").alias("l")).hint("merge"), "first")
    cut = cut.join(known.select(F.col("ids").alias("rest"), F.col("f").alias("r")).hint("merge"), "rest")
    score = F.expr(f"cast(({p.scale} * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as long)")
    weakest = cut.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # the most frequent longer phrase around each
    inside = F.expr("flatten(transform(sequence(2, gram - 1), n -> transform(sequence(1, gram - n + 1), i -> slice(ids, i, n))))")
    around = phrases.where("gram > 2").select(F.col("f"), F.explode(inside).alias("ids")).groupBy("ids").agg(F.max("f").alias("around"))
    rows = weakest.join(around.hint("merge"), "ids", "left")
    rows = rows.where(F.expr(f"around is null or cast(100 as decimal(20,0)) * around < cast({p.cover} as decimal(20,0)) * a"))
    return rows.select("ids", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Of (text, lang) each language's ``top`` phrases: lang, rank, phrase, a
    (its count), l and r (those of its parts), n (the language's words), score."""
    spark = docs.sparkSession
    packed = keep(chunks(docs, p), "collocations-chunks")
    numbered, own, size = vocabulary(packed, p)
    sizes = keep(packed.groupBy("lang").agg(F.sum("n").alias("n")), "collocations-sizes")  # a row a language
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(parts(spark), total // p.shard_words)
    if size >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    layout = Layout(max(1, size.bit_length()), max(0, shards - 1).bit_length())
    texts = keep(encoded(packed, own, numbered), "collocations-texts")
    two = keep(merged(pairs(texts, layout), layout, p.least, True), "collocations-pairs")
    flags = two.where("flags is not null").select("chunk", "shard", "flags")
    more = merged(longer(texts, flags, layout), layout, p.least, False)
    phrases = keep(two.where("ids is not null").select("gram", "ids", "f").unionByName(more.select("gram", "ids", "f")), "collocations-phrases")
    rows = scores(phrases, numbered, p)
    word = numbered.select("id", "lang", "word").hint("merge")
    said = (rows.select("*", F.posexplode("ids").alias("at", "id")).join(word, "id").groupBy("ids")
            .agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
                 *[F.first(c).alias(c) for c in ("a", "l", "r", "score")]))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # ranked within hashed parts of a language first, so that a task holds a part
    some = said.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts(spark))))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= p.top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= p.top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
