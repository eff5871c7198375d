"""File admission checks (TRI-1..6).

One status column per file, first failing check wins in the order size ->
format -> page count -> encryption; ``pass_quarantine`` splits the table.
All checks are narrow column expressions over the file bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.files import read_files

# FIXED VALUES: admission limits and markers
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_PAGES = 50
PDF_MAGIC = b"%PDF"
PAGE_MARKER = r"/Type\s*/Page[^s]"
ENCRYPT_MARKER = "/Encrypt"


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = MAX_FILE_BYTES
    max_pages: int = MAX_PAGES


def page_estimate(content) -> F.Column:
    """TRI-3: matches of ``/Type\\s*/Page[^s]`` in the Latin-1 text, 1 when
    none (Java \\s and JS \\s agree on Latin-1 except NEL/NBSP, spelled out)."""
    text = F.decode(content, "ISO-8859-1")
    pattern = r"/Type[\t\n\x0B\f\r \x{A0}]*/Page[^s]"
    n = F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.greatest(n, F.lit(1))


def triage(files: DataFrame, limits: Limits = Limits(), content: str = "content",
           length: str = "length") -> DataFrame:
    """Adds ``size``, ``est_pages``, ``encrypted`` and ``status``
    (``OK`` or the error type)."""
    c = F.col(content)
    size = F.coalesce(F.col(length), F.length(c)).cast("long")
    is_pdf = F.substring(c, 1, 4) == F.lit(bytearray(PDF_MAGIC))
    pages = page_estimate(c)
    encrypted = F.instr(F.decode(c, "ISO-8859-1"), ENCRYPT_MARKER) > 0
    status = (F.when(size > limits.max_file_bytes, "SIZE_LIMIT_ERROR")
              .when(~is_pdf, "FILE_ERROR")
              .when(pages > limits.max_pages, "PAGE_LIMIT_ERROR")
              .when(encrypted, "SECURITY_ERROR")
              .otherwise("OK"))
    return files.select("*", size.alias("size"), pages.cast("long").alias("est_pages"),
                        encrypted.alias("encrypted"), status.alias("status"))


def triage_path(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """TRI-1..5 over the files under ``path``: sizes are judged from the file
    listing, and only files within the size limit are read.  ``(path, size,
    est_pages, encrypted, status)``; the middle two are NULL where the size
    alone decided."""
    files = read_files(spark, path)
    large = (files.select("path", "length").filter(F.col("length") > limits.max_file_bytes)
             .select("path", F.col("length").alias("size"), F.lit(None).cast("long").alias("est_pages"),
                     F.lit(None).cast("boolean").alias("encrypted"), F.lit("SIZE_LIMIT_ERROR").alias("status")))
    small = triage(files.filter(F.col("length") <= limits.max_file_bytes), limits)
    return small.select("path", "size", "est_pages", "encrypted", "status").unionByName(large)


def pass_quarantine(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TRI-6: admitted files and quarantined files."""
    return (triaged.filter(F.col("status") == "OK"),
            triaged.filter(F.col("status") != "OK"))
