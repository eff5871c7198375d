"""Raw document files (SRC-3): ``binaryFile`` source and derived files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, content)`` of every file under
    ``path``, whatever its name: triage judges a file by its bytes.  The
    source always knows ``length``, and a filter on it is pushed down, so the
    bytes of files it refuses are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


# D4: file bytes per part (shared SQL text; same in DuckDB for the oracle)
FILE_TEXT = """concat(
  CASE WHEN p_partkey % 11 = 0 THEN 'PK..' ELSE '%PDF-1.4' END, {nl},
  repeat(concat('/Type /Page', {nl}), p_size * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END),
  '/Type /Pages', {nl},
  CASE WHEN p_partkey % 13 = 0 THEN '/Encrypt' ELSE '' END)"""


def file_text(dialect: str) -> str:
    return FILE_TEXT.format(nl="'\\n'" if dialect == "spark" else "chr(10)")


def part_files(part: DataFrame) -> DataFrame:
    """D4: ``(doc_id, path, length, content)`` derived from ``part``."""
    return (part.select(F.col("p_partkey").alias("doc_id"),
                        F.expr(file_text("spark")).cast("binary").alias("content"))
            .select("doc_id", F.concat(F.lit("part-"), F.col("doc_id").cast("string"),
                                       F.lit(".pdf")).alias("path"),
                    F.length("content").cast("long").alias("length"), "content"))
