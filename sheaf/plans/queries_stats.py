"""Registered statistics queries (AGG-4, AGG-9..12, JN-8, LIM-1..3) over the
D3 block graphs; oracles from the base tables (CTEs of ``BASE``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import assemble as A
from sheaf.functions import rules as R
from sheaf.functions.numbers import round6, round6_sql
from sheaf.operators import metrics as M
from sheaf.operators import stats as S
from sheaf.plans import duck as D
from sheaf.plans.queries_blocks import BASE, blocks_of
from sheaf.plans.registry import register
from sheaf.session import materialize
from sheaf.sinks import results as SR
from sheaf.sinks.results import kb_text
from sheaf.sources.derived import page_shapes, run_phases
from sheaf.sources.files import file_text, part_files
from sheaf.sources.tables import table
from sheaf.streaming import totals as T


def _ocr(b):
    return S.word_stats(b)


@register("page_word_stats", "AGG-4 word-level page statistics",
          BASE + f"SELECT doc_id, page_number, text, {round6_sql('confidence')} AS confidence, word_count FROM ocr")
def page_word_stats(spark, sf_dir):
    return _ocr(blocks_of(spark, sf_dir)).withColumn("confidence", round6("confidence"))


@register("ocr_totals", "AGG-11 OCR totals per document",
          BASE + f"""SELECT doc_id, CAST(sum(word_count) AS BIGINT) AS total_words,
       CAST(sum(length(text)) AS BIGINT) AS total_characters,
       {round6_sql('coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0)')} AS average_confidence
FROM ocr GROUP BY doc_id""")
def ocr_totals(spark, sf_dir):
    return (S.ocr_totals(_ocr(blocks_of(spark, sf_dir)))
            .withColumn("average_confidence", round6("average_confidence")))


@register("shape_totals", "AGG-10 shape totals per document",
          BASE + """SELECT doc_id, count(*) FILTER (WHERE enabled) AS enabled_pages,
       CAST(sum(coalesce(shape_count, 0)) AS BIGINT) AS total_shapes_found,
       coalesce(string_agg(dominant_shape, ', ' ORDER BY page_number)
                FILTER (WHERE dominant_shape IS NOT NULL AND dominant_shape <> ''
                        AND dominant_shape <> 'unknown'), '') AS dominant_shapes
FROM shapes GROUP BY doc_id""")
def shape_totals(spark, sf_dir):
    pl = A.page_list(blocks_of(spark, sf_dir))
    return (S.shape_totals(page_shapes(pl))
            .withColumn("dominant_shapes", F.array_join("dominant_shapes", ", ")))


@register("page_report", "JN-8 OCR page left-join shapes with placeholders",
          BASE + f"""SELECT s.doc_id, s.page_number,
       CASE WHEN o.word_count IS NULL THEN '[Not processed in this test]' ELSE o.text END AS text,
       CAST(coalesce(o.word_count, 0) AS BIGINT) AS word_count,
       {round6_sql('coalesce(o.confidence, 0)')} AS confidence,
       s.enabled, s.shape_count, s.dominant_shape
FROM shapes s LEFT JOIN ocr o ON o.doc_id = s.doc_id AND o.page_number = s.page_number""")
def page_report(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    pl = A.page_list(b)
    return (S.page_report(pl, _ocr(b), page_shapes(pl)).drop("processed")
            .withColumn("confidence", round6("confidence")))


@register("doc_totals", "AGG-9 per-document totals with a grand-total rollup row",
          BASE + """SELECT doc_id, CAST(pages AS BIGINT) AS pages, CAST(text_chars AS BIGINT) AS text_chars,
       CAST(tables AS BIGINT) AS tables, CAST(forms AS BIGINT) AS forms FROM totals""")
def doc_totals(spark, sf_dir):
    return S.doc_totals(A.pages(blocks_of(spark, sf_dir)))


@register("corpus_totals_by_epoch", "AGG-9 corpus totals after each of three deliveries, by signed deltas", BASE + """,
d AS (SELECT *, doc_id % 3 = 0 AS again, doc_id % 5 = 4 AS late, doc_id % 7 = 0 AND doc_id % 5 <> 4 AS gone FROM totals WHERE doc_id IS NOT NULL),
e AS (SELECT 0 AS seq, pages, text_chars, tables, forms FROM d WHERE NOT late
      UNION ALL SELECT 1, pages, text_chars + CASE WHEN again THEN 10 ELSE 0 END, tables + CASE WHEN again THEN 1 ELSE 0 END, forms
      FROM d WHERE NOT late OR again
      UNION ALL SELECT 2, pages, text_chars + CASE WHEN again AND NOT late THEN 10 ELSE 0 END,
                       tables + CASE WHEN again AND NOT late THEN 1 ELSE 0 END, forms FROM d WHERE NOT gone)
SELECT CAST(seq AS BIGINT) AS seq, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(text_chars) AS BIGINT) AS text_chars,
       CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(forms) AS BIGINT) AS forms FROM e GROUP BY seq""")
def corpus_totals_by_epoch(spark, sf_dir):
    """Most documents; then every third one again, changed; then the others
    and the end of every seventh of the first ones."""
    docs = materialize(S.doc_totals(A.pages(blocks_of(spark, sf_dir))).where("doc_id is not null"), "totals-documents")
    key = F.col("doc_id")
    late, again = key % 5 == 4, key % 3 == 0
    first = docs.where(~late).withColumn("seq", F.lit(0)).withColumn("_deleted", F.lit(False))
    second = (docs.where(again).withColumn("seq", F.lit(1)).withColumn("_deleted", F.lit(False))
              .withColumn("text_chars", F.col("text_chars") + 10).withColumn("tables", F.col("tables") + 1))
    third = docs.where(late | (key % 7 == 0)).withColumn("seq", F.lit(2)).withColumn("_deleted", ~late)
    return T.totals_by_seq(T.signed_deltas(first.unionByName(second).unionByName(third)))


@register("cost_estimate", "AGG-12 cost estimate (exact decimals, fixed places)",
          BASE + """SELECT doc_id,
       CAST(CAST(round(CAST(pages AS DECIMAL(20,0)) * 0.0015, 4) AS DECIMAL(24,4)) AS VARCHAR) AS text_usd,
       CAST(CAST(round(CAST(pages AS DECIMAL(20,0)) * 0.001, 4) AS DECIMAL(24,4)) AS VARCHAR) AS image_usd,
       CAST(CAST(round(CAST(pages AS DECIMAL(20,0)) * 0.0015 + CAST(pages AS DECIMAL(20,0)) * 0.001, 4)
            AS DECIMAL(24,4)) AS VARCHAR) AS total_usd,
       CAST(CAST(round(round(CAST(pages AS DECIMAL(20,0)) * 0.0015 + CAST(pages AS DECIMAL(20,0)) * 0.001, 4)
            * 150, 2) AS DECIMAL(24,2)) AS VARCHAR) AS total_jpy
FROM totals""")
def cost_estimate(spark, sf_dir):
    return S.cost_estimate(S.doc_totals(A.pages(blocks_of(spark, sf_dir))))


@register("table_preview", "LIM-1 first 2 tables x first 3 rows with remaining-row count",
          BASE + """, r AS (
  SELECT doc_id, table_no, row_no, string_agg(text, ' | ' ORDER BY col_no) AS row_text
  FROM grid WHERE table_no <= 2 GROUP BY ALL),
n AS (SELECT doc_id, table_no, count(*) AS n_rows FROM r GROUP BY ALL)
SELECT r.doc_id, r.table_no, r.row_no, r.row_text, CAST(greatest(n.n_rows - 3, 0) AS BIGINT) AS more_rows
FROM r JOIN n ON n.doc_id = r.doc_id AND n.table_no = r.table_no WHERE r.row_no <= 3""")
def table_preview(spark, sf_dir):
    cells = A.table_cells(blocks_of(spark, sf_dir), "document")
    return S.table_preview(A.table_grid(cells, "document"), cells=cells)


@register("first_table_rows", "LIM-2 first page with tables, first 3 rows of its first table", BASE + """
SELECT f.doc_id, f.page_number, g.row_no, string_agg(g.text, ' | ' ORDER BY g.col_no) AS row_text
FROM (SELECT doc_id, min(page_number) AS page_number FROM page_text WHERE n_tables > 0 GROUP BY doc_id) f
JOIN tbl t ON t.doc_id = f.doc_id AND t.page = f.page_number
JOIN grid g ON g.doc_id = f.doc_id AND g.table_no = t.table_no
WHERE g.row_no <= 3 GROUP BY f.doc_id, f.page_number, g.row_no""")
def first_table_rows(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return S.first_table(A.pages(b), A.table_grid(A.table_cells(b, "page"), "page"))


@register("first_table_page", "LIM-2 first page with tables",
          BASE + "SELECT doc_id, min(page_number) AS page_number FROM page_text WHERE n_tables > 0 GROUP BY doc_id")
def first_table_page(spark, sf_dir):
    return S.first_table_page(A.pages(blocks_of(spark, sf_dir)))


@register("page_samples", "LIM-3 first 3 pages with a 100-char text sample",
          BASE + """SELECT doc_id, page_number,
       replace(substr(text, 1, 100), chr(10), ' ') || CASE WHEN length(text) > 100 THEN '...' ELSE '' END
         AS sample
FROM page_text WHERE page_number <= 3""")
def page_samples(spark, sf_dir):
    return S.page_samples(A.pages(blocks_of(spark, sf_dir)))


@register("ocr_samples", "LIM-3 variant: first 80 chars of word text, whitespace runs collapsed",
          BASE + f"""SELECT doc_id, page_number,
       regexp_replace(substr(text, 1, 80), {D.q(R.WS + '+')}, ' ', 'g')
         || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS sample
FROM ocr WHERE page_number <= 3 AND length(text) > 0""")
def ocr_samples(spark, sf_dir):
    o = _ocr(blocks_of(spark, sf_dir)).filter(F.length("text") > 0)
    return S.page_samples(o, n_pages=3, chars=80, collapse="space")


@register("file_sizes", "TXT-26 sizes as fixed-decimal KB text", """
SELECT p_partkey AS doc_id,
       CAST(CAST(round(CAST(length(t) AS DECIMAL(20,0)) * 0.0009765625, 1) AS DECIMAL(30,1)) AS VARCHAR)
         || 'KB' AS size_kb
FROM (SELECT p_partkey, """ + file_text("duck") + """ AS t FROM part)""")
def file_sizes(spark, sf_dir):
    f = part_files(table(spark, sf_dir, "part"))
    return f.select("doc_id", kb_text(F.col("length")).alias("size_kb"))


RUN = {"version": "3.0", "timestamp": "2024-02-01T00:00:00.000Z", "region": "us-east-1"}
REPORT = ("version string, timestamp string, "
          "document_info struct<total_pages:long,ocr_processed_pages:long,processing_region:string,ocr_text_characters:long,detected_tables:long,detected_forms:long>, "
          "performance_metrics struct<conversion_time_seconds:double,shapes_detection_time_seconds:double,total_processing_time:double>, "
          "statistics struct<ocr:struct<total_words:long,total_characters:long,average_confidence:double>,"
          "shapes:struct<enabled_pages:long,total_shapes_found:long,dominant_shapes:array<string>>>, "
          "estimated_cost struct<text_usd:string,image_usd:string,total_usd:string,total_jpy:string>, "
          "pages array<struct<page_number:long,ocr_results:struct<text:string,word_count:long,confidence:double>,"
          "shapes:struct<enabled:boolean,shape_count:int,dominant_shape:string>>>")


@register("stats_report", "SNK-3 nested statistics report per document, rendered as JSON (TXT-27) and read back", BASE + f""",
cost AS (
  SELECT doc_id, CAST(pages AS DECIMAL(20,0)) * 0.0015 AS t, CAST(pages AS DECIMAL(20,0)) * 0.001 AS i FROM totals WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, sum(word_count) AS w, sum(length(text)) AS c, coalesce(avg(confidence) FILTER (WHERE confidence > 0), 0) AS f
      FROM ocr GROUP BY doc_id),
sh AS (SELECT doc_id, count(*) FILTER (WHERE enabled) AS e, sum(shape_count) AS n,
              coalesce(string_agg(dominant_shape, ',' ORDER BY page_number) FILTER (WHERE dominant_shape <> 'unknown'), '') AS d
       FROM shapes GROUP BY doc_id),
p AS (SELECT s.doc_id, string_agg(CAST(s.page_number AS VARCHAR) || '|' || coalesce(o.text, '[Not processed in this test]') || '|'
             || CAST(coalesce(o.word_count, 0) AS VARCHAR) || '|' || CASE WHEN s.enabled THEN 'true' ELSE 'false' END || '|'
             || CAST(s.shape_count AS VARCHAR) || '|' || coalesce(s.dominant_shape, ''), chr(10) ORDER BY s.page_number) AS page_list,
             count(o.word_count) AS processed
      FROM shapes s LEFT JOIN ocr o ON o.doc_id = s.doc_id AND o.page_number = s.page_number GROUP BY s.doc_id),
runs AS (SELECT event_id // 2 AS doc_id, max(value) FILTER (WHERE event_id % 2 = 0) AS c, max(value) FILTER (WHERE event_id % 2 = 1) AS s
         FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT totals.doc_id, {D.q(RUN['version'])} AS version, {D.q(RUN['timestamp'])} AS timestamp, {D.q(RUN['region'])} AS processing_region,
       coalesce(p.processed, 0) AS ocr_processed_pages, {round6_sql('runs.c')} AS conversion_time_seconds,
       {round6_sql('runs.s')} AS shapes_detection_time_seconds, {round6_sql('runs.c + runs.s')} AS total_processing_time,
       CAST(pages AS BIGINT) AS total_pages, CAST(text_chars AS BIGINT) AS ocr_text_characters,
       CAST(tables AS BIGINT) AS detected_tables, CAST(forms AS BIGINT) AS detected_forms,
       CAST(o.w AS BIGINT) AS total_words, CAST(o.c AS BIGINT) AS total_characters, {round6_sql('o.f')} AS average_confidence,
       sh.e AS enabled_pages, CAST(sh.n AS BIGINT) AS total_shapes_found, sh.d AS dominant_shapes,
       CAST(CAST(round(t, 4) AS DECIMAL(24,4)) AS VARCHAR) AS text_usd, CAST(CAST(round(i, 4) AS DECIMAL(24,4)) AS VARCHAR) AS image_usd,
       CAST(CAST(round(t + i, 4) AS DECIMAL(24,4)) AS VARCHAR) AS total_usd,
       CAST(CAST(round(round(t + i, 4) * 150, 2) AS DECIMAL(24,2)) AS VARCHAR) AS total_jpy, p.page_list
FROM totals JOIN cost ON cost.doc_id = totals.doc_id LEFT JOIN o ON o.doc_id = totals.doc_id
LEFT JOIN sh ON sh.doc_id = totals.doc_id LEFT JOIN p ON p.doc_id = totals.doc_id
LEFT JOIN runs ON runs.doc_id = totals.doc_id""")
def stats_report(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    pl = A.page_list(b)
    # a row a document, read twice: kept, so that the pages are resolved once
    totals = materialize(S.doc_totals(A.pages(b)), "report-totals")
    ocr = _ocr(b)
    shapes = page_shapes(pl)
    report = SR.stats_report(totals, S.ocr_totals(ocr), S.shape_totals(shapes),
                             S.page_report(pl, ocr, shapes), S.cost_estimate(totals),
                             M.run_seconds(run_phases(table(spark, sf_dir, "events"))), RUN)
    r = SR.render_json(report, pretty=False).select("doc_id", F.from_json("json", REPORT).alias("r")).select("doc_id", "r.*")
    page = lambda x: F.concat_ws("|", x["page_number"].cast("string"), x["ocr_results"]["text"], x["ocr_results"]["word_count"].cast("string"),
                                 x["shapes"]["enabled"].cast("string"), x["shapes"]["shape_count"].cast("string"),
                                 F.coalesce(x["shapes"]["dominant_shape"], F.lit("")))
    times = [round6(f"performance_metrics.{c}").alias(c) for c in ("conversion_time_seconds", "shapes_detection_time_seconds", "total_processing_time")]
    return r.select("doc_id", "version", "timestamp", *times, "document_info.*", "statistics.ocr.total_words", "statistics.ocr.total_characters",
                    round6("statistics.ocr.average_confidence").alias("average_confidence"),
                    "statistics.shapes.enabled_pages", "statistics.shapes.total_shapes_found",
                    F.array_join("statistics.shapes.dominant_shapes", ",").alias("dominant_shapes"), "estimated_cost.*",
                    F.array_join(F.transform("pages", page), "\n").alias("page_list"))
