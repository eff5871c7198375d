"""Steps that several operators share: intermediate tables in the shared
folder, sizes of inputs, ids of documents as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import materialize
from sheaf.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the folder of ``spark.checkpoint.dir``, which
    every executor shares; a lost executor only costs its running tasks."""
    return materialize(df, name)


def drop(*tables: DataFrame) -> None:
    """Empty kept tables that nothing reads any more: an overwrite without rows
    deletes their files wherever the shared folder is."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def part_of(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
