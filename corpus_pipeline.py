"""A corpus pipeline over ``documents``: STAGES in order, each on what the one
before it kept, written as Parquet and read again in between.

toxicity       rows that the classifier rejects go
near_dedup     one document of each group of near copies (0.8 or more) stays
passage_dedup  passages of 40 words or more that an earlier document has are cut
mixing         sources at their target weights: rows left out, repeated or cut
packing        the pieces of all rows in sequences of 4096 tokens

All but the last return the columns of documents; ``n_chars`` follows a text
that was cut.  Null or empty texts, repeated rows, null ids and extra columns
pass every stage by the rules of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sheaf.llm import mixing, neardup, packing, passages, toxicity
from sheaf.llm.queries import tokenizers_path
from sheaf.llm.tables import documents, keep
from sheaf.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` with a score below 0.5; learns from its labelled rows."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the smallest doc_id of each group, equal rows of it once."""
    found = neardup.near_duplicates(docs, neardup.Params(percent=80, rows=4, bands=32))
    stays = found.where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.join(stays.hint("merge"), "doc_id", "left_semi")
    again = W.partitionBy("doc_id").orderBy("text")
    rows = rows.withColumn("__again", F.col("text").eqNullSafe(F.lag("text").over(again)) & (F.row_number().over(again) > 1))
    return rows.where("not __again").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(passages.cut(docs, passages.passages(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn rows in the order of the output shards."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    rows = mixing.write_order(mixing.draw(docs, carry=carry, prefix="__"), prefix="__")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "__shard", "__place").sortWithinPartitions("__shard", "__place")
    text: Column = F.when(F.col("__words") < F.col("__size"), mixing.cut(F.col("text"), F.col("__words"))).otherwise(F.col("text"))
    return _counted(rows.withColumn("text", text).select(*docs.columns), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizers_path("word_bpe_49k.json")))


def _counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """With the number of code points of each text in ``n_chars``, if there is one."""
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


#: (name, function): toxicity (operator 9), MinHash near-dedup (2), substring
#: dedup (10), mixing sources (5), best-fit packing (6).
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Classifier, MinHash, alignment, random draw and tokens are not SQL; the
#: stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
