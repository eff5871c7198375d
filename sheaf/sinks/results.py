"""Result sinks (SNK-1, SNK-3) and rendering (TXT-26, TXT-27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheaf.sinks import store


def write_results(docs: DataFrame, path: str, folders: int | None = None, txn: str | None = None) -> None:
    """SNK-1: the documents' rows as the next epoch of the store at ``path``.
    Re-running replaces exactly the documents it carries; rows of others are
    neither read nor written.  ``folders``: into so many files."""
    store.append(docs, path, txn=txn, files=folders)


def read_results(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The current result of each document."""
    return store.latest(spark, path, schema)


def render_json(docs: DataFrame, pretty: bool = True) -> DataFrame:
    """TXT-27: ``(doc_id, json)``; NULL fields are left out."""
    body = F.struct(*[c for c in docs.columns if c != "doc_id"])
    opts = {"ignoreNullFields": "true"}
    if pretty:
        opts["pretty"] = "true"
    return docs.select("doc_id", F.to_json(body, opts).alias("json"))


def kb_text(bytes_col, places: int = 1):
    """TXT-26: byte count as ``<n>KB`` with ``places`` decimals, rounded half
    up on the exact value (bytes x 0.0009765625 is exact in decimal)."""
    from decimal import Decimal
    kb = bytes_col.cast("decimal(20,0)") * F.lit(Decimal("0.0009765625"))
    return F.concat(F.round(kb, places).cast(f"decimal(30,{places})").cast("string"), F.lit("KB"))


def mb_text(bytes_col, places: int = 1):
    """TXT-26: byte count as ``<n>MB`` with ``places`` decimals."""
    from decimal import Decimal
    mb = bytes_col.cast("decimal(20,0)") * F.lit(Decimal("0.00000095367431640625"))
    return F.concat(F.round(mb, places).cast(f"decimal(30,{places})").cast("string"), F.lit("MB"))


def stats_report(totals: DataFrame, ocr: DataFrame, shapes: DataFrame, pages: DataFrame,
                 cost: DataFrame, runs: DataFrame | None = None, envelope: dict | None = None) -> DataFrame:
    """SNK-3: one nested statistics report per document: document info,
    performance metrics, statistics (OCR, shapes), cost estimate and the page
    list.  The page list is grouped per document (bounded by the page limit).

    ``runs``: ``(doc_id, conversion_s, shapes_s)``, see ``metrics.run_seconds``;
    a document without a run has NULL metrics.  ``envelope``: ``version``,
    ``timestamp`` and ``region`` of the run, the same in each report."""
    page_list = (pages.groupBy("doc_id")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     "page_number",
                     F.struct("text", "word_count", "confidence").alias("ocr_results"),
                     F.struct("enabled", "shape_count", "dominant_shape").alias("shapes"))))
                      .alias("page_rows"),
                      F.count_if("processed").alias("ocr_processed_pages")))
    given = {k: (envelope or {}).get(k) for k in ("version", "timestamp", "region")}
    rows = (totals.filter(F.col("doc_id").isNotNull())
            .join(ocr, "doc_id", "left").join(shapes, "doc_id", "left")
            .join(cost, "doc_id", "left").join(page_list, "doc_id", "left"))
    rows = (rows.join(runs, "doc_id", "left") if runs is not None
            else rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("conversion_s", "shapes_s")]))
    return (rows
            .select("doc_id", F.lit(given["version"]).cast("string").alias("version"),
                    F.lit(given["timestamp"]).cast("string").alias("timestamp"),
                    F.struct(F.col("pages").alias("total_pages"),
                             F.coalesce("ocr_processed_pages", F.lit(0)).alias("ocr_processed_pages"),
                             F.lit(given["region"]).cast("string").alias("processing_region"),
                             F.col("text_chars").alias("ocr_text_characters"),
                             F.col("tables").alias("detected_tables"),
                             F.col("forms").alias("detected_forms")).alias("document_info"),
                    F.struct(F.col("conversion_s").alias("conversion_time_seconds"),
                             F.col("shapes_s").alias("shapes_detection_time_seconds"),
                             (F.col("conversion_s") + F.col("shapes_s")).alias("total_processing_time")).alias("performance_metrics"),
                    F.struct(
                        F.struct("total_words", "total_characters", "average_confidence").alias("ocr"),
                        F.struct("enabled_pages", "total_shapes_found", "dominant_shapes")
                        .alias("shapes")).alias("statistics"),
                    F.struct("text_usd", "image_usd", "total_usd", "total_jpy").alias("estimated_cost"),
                    F.col("page_rows").alias("pages")))


def observe_pages(pages: DataFrame, name: str = "pages") -> tuple[DataFrame, Observation]:
    """The page rows with an observation of the run: its pages, those that OCR
    processed and the placeholders.  The counts come with the action that
    writes the rows; no pass of their own."""
    seen = Observation(name)
    return pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.count_if("processed").alias("processed_pages"),
                         F.count_if(~F.col("processed")).alias("placeholder_pages")), seen
