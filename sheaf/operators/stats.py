"""Corpus and document statistics (AGG-4, AGG-9..12, JN-8, LIM-1..3).

Everything is a grouped aggregate with map-side partial aggregation; the
per-document lists (dominant shapes, previews) are bounded by a document's
page count.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import batches as B
from sheaf.functions.text import js_trim

# FIXED VALUES: text of a page without OCR result, published price assumptions
PLACEHOLDER_TEXT = "[Not processed in this test]"
# price assumptions (parameters; defaults are the published estimate)
TEXT_RATE_USD = Decimal("0.0015")
IMAGE_RATE_USD = Decimal("0.001")
YEN_PER_USD = Decimal("150")


def word_stats(blocks: DataFrame) -> DataFrame:
    """AGG-4 per ``(doc_id, page)``: WORD texts (non-empty) joined by a space
    and trimmed; mean confidence of words with a non-zero confidence,
    scaled to 0..1 (0 when none); ``word_count`` counts those words."""
    w = blocks.filter((F.col("block_type") == "WORD") & (F.length("text") > 0)
                      & F.col("page").isNotNull())
    scored = F.coalesce(F.col("confidence") != 0, F.lit(False))
    return (w.groupBy("doc_id", "page")
            .agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("ws"),
                 F.avg(F.when(scored, F.col("confidence"))).alias("c"),
                 F.count_if(scored).alias("word_count"))
            .select("doc_id", F.col("page").cast("long").alias("page_number"),
                    js_trim(F.array_join(F.transform("ws", lambda x: x["text"]), " ")).alias("text"),
                    (F.coalesce("c", F.lit(0.0)) / 100).alias("confidence"),
                    F.col("word_count").cast("long").alias("word_count")))


def ocr_totals(ocr: DataFrame) -> DataFrame:
    """AGG-11 per document: words, characters, mean confidence over pages
    whose confidence is > 0 (0 when none)."""
    return (ocr.groupBy("doc_id")
            .agg(F.sum("word_count").cast("long").alias("total_words"),
                 F.sum(F.length("text")).cast("long").alias("total_characters"),
                 F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))),
                            F.lit(0.0)).alias("average_confidence")))


def shape_totals(shapes: DataFrame) -> DataFrame:
    """AGG-10 per document: enabled pages, total shapes, dominant shapes
    (not empty, not 'unknown') in page order."""
    dom = F.col("dominant_shape")
    keep = dom.isNotNull() & (dom != "") & (dom != "unknown")
    return (shapes.groupBy("doc_id")
            .agg(F.count_if(F.coalesce("enabled", F.lit(False))).cast("long").alias("enabled_pages"),
                 F.sum(F.coalesce("shape_count", F.lit(0))).cast("long").alias("total_shapes_found"),
                 F.array_sort(F.collect_list(F.when(keep, F.struct("page_number", dom.alias("s")))))
                 .alias("d"))
            .select("doc_id", "enabled_pages", "total_shapes_found",
                    F.transform("d", lambda x: x["s"]).alias("dominant_shapes")))


def page_report(page_numbers: DataFrame, ocr: DataFrame, shapes: DataFrame) -> DataFrame:
    """JN-8: every page of every document with its OCR result (placeholder
    text, 0 words, confidence 0 when missing) and its shape result;
    ``processed``: whether it has an OCR result."""
    o = ocr.select("doc_id", "page_number", F.col("text").alias("o_text"),
                   F.col("word_count").alias("o_words"), F.col("confidence").alias("o_conf"))
    s = shapes.select("doc_id", "page_number", "enabled", "shape_count", "dominant_shape")
    return (page_numbers.select("doc_id", "page_number")
            .join(o, ["doc_id", "page_number"], "left")
            .join(s, ["doc_id", "page_number"], "left")
            .select("doc_id", "page_number",
                    F.when(F.col("o_words").isNull(), F.lit(PLACEHOLDER_TEXT))
                    .otherwise(F.col("o_text")).alias("text"),
                    F.coalesce("o_words", F.lit(0)).cast("long").alias("word_count"),
                    F.coalesce("o_conf", F.lit(0.0)).alias("confidence"),
                    "enabled", "shape_count", "dominant_shape",
                    F.col("o_words").isNotNull().alias("processed")))


def doc_totals(pages: DataFrame) -> DataFrame:
    """AGG-9 per document plus a grand-total row (``doc_id`` NULL):
    pages, characters of page text, tables and forms on pages."""
    return (pages.rollup("doc_id")
            .agg(F.count(F.lit(1)).cast("long").alias("pages"),
                 F.sum(F.length("text")).cast("long").alias("text_chars"),
                 F.sum("n_tables").cast("long").alias("tables"),
                 F.sum("n_forms").cast("long").alias("forms")))


def cost_estimate(totals: DataFrame, text_pages: str = "pages", image_pages: str = "pages",
                  text_rate: Decimal = TEXT_RATE_USD, image_rate: Decimal = IMAGE_RATE_USD,
                  yen: Decimal = YEN_PER_USD) -> DataFrame:
    """AGG-12 with exact decimal arithmetic: text and image cost (4
    decimals), total, and the yen figure (2 decimals), as printed text."""
    tp = F.col(text_pages).cast("decimal(20,0)")
    ip = F.col(image_pages).cast("decimal(20,0)")
    text_usd = tp * F.lit(text_rate)
    image_usd = ip * F.lit(image_rate)
    total = text_usd + image_usd
    fixed = lambda c, d: F.round(c, d).cast(f"decimal(24,{d})").cast("string")
    return totals.select(
        "doc_id",
        fixed(text_usd, 4).alias("text_usd"),
        fixed(image_usd, 4).alias("image_usd"),
        fixed(total, 4).alias("total_usd"),
        fixed(F.round(total, 4) * F.lit(yen), 2).alias("total_jpy"))


def table_preview(grid: DataFrame, tables: int = 2, rows: int = 3, cells: DataFrame | None = None) -> DataFrame:
    """LIM-1: first ``tables`` tables per document, first ``rows`` rows each
    (cells joined by ' | '), with the count of rows not shown.  With ``cells``
    a table that has cells but no grid is one row 0 that tells their number."""
    def made(slots: pa.Array, own: pa.Array) -> pa.Array:
        found = B.preview(slots, own, tables, rows)
        doc = found.pop("doc")
        return B.lists(doc, len(slots), pa.StructArray.from_arrays([pa.array(c) for c in found.values()], list(found)))

    whole = getattr(grid, "whole", None)
    # a grid that was made of these cells has them in the same rows
    if whole is None or cells is None or getattr(cells, "whole", None) is None or "cells" not in whole.columns or grid.made_of is not cells:
        slots = grid.select("doc_id", F.struct("table_no", "row_no", "col_no", "text").alias("grid"))
        own = (grid.limit(0) if cells is None else cells).select("doc_id", F.struct("table_no").alias("cells"))
        whole = (slots.unionByName(own, allowMissingColumns=True).groupBy("doc_id")
                 .agg(F.collect_list("grid").alias("grid"), F.collect_list("cells").alias("cells")))
    out = B.listed(whole, made, "array<struct<table_no:bigint,row_no:bigint,row_text:string,more_rows:bigint>>", "grid", "cells")
    return out.select("doc_id", F.explode("out").alias("r")).select("doc_id", "r.*")


def first_table_page(pages: DataFrame) -> DataFrame:
    """LIM-2: first page (by number) that has tables, per document."""
    return (pages.filter(F.col("n_tables") > 0)
            .groupBy("doc_id")
            .agg(F.min("page_number").alias("page_number")))


def first_table(pages: DataFrame, page_grid: DataFrame, rows: int = 3) -> DataFrame:
    """LIM-2: the first page that has tables and the first ``rows`` rows of
    its first table (cells joined by ' | ').  ``page_grid``: the grid of page
    scope with ``page``."""
    first = pages.filter(F.col("n_tables") > 0).groupBy("doc_id").agg(F.min(F.struct("page_number", "page")).alias("p")).select("doc_id", "p.*")
    top = page_grid.filter((F.col("table_no") == 1) & (F.col("row_no") <= rows))
    return (first.join(top, ["doc_id", "page"]).groupBy("doc_id", "page_number", "row_no")
            .agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("cs"))
            .select("doc_id", "page_number", "row_no", F.array_join(F.transform("cs", lambda x: x["text"]), " | ").alias("row_text")))


def page_samples(pages: DataFrame, n_pages: int = 3, chars: int = 100,
                 collapse: str = "newline") -> DataFrame:
    """LIM-3: first ``n_pages`` pages per document with a text sample: first
    ``chars`` characters with newlines (``collapse='newline'``) or
    whitespace runs (``'space'``) turned into one space, ``...`` when cut."""
    head = F.substring("text", 1, chars)
    sample = (F.regexp_replace(head, "\n", " ") if collapse == "newline"
              else F.regexp_replace(head, r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
                                          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", " "))
    return (pages.filter(F.col("page_number") <= n_pages)
            .select("doc_id", "page_number",
                    F.concat(sample, F.when(F.length("text") > chars, F.lit("...")).otherwise(F.lit("")))
                    .alias("sample")))
