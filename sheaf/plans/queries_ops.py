"""Registered triage, event, usage and metrics queries (TRI-*, SRC-1/2,
SNK-2, AGG-13..16, WIN-4, PRJ-6/7) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.numbers import round6, round6_sql
from sheaf.operators import metrics as M
from sheaf.operators import triage as TR
from sheaf.operators import usage as U
from sheaf.plans.registry import register
from sheaf.sources import derived as DV
from sheaf.sources.events import document_events, event_records, result_location
from sheaf.sources import logs as LG
from sheaf.sources.files import file_text, part_files
from sheaf.session import materialize
from sheaf.sources.tables import table

# limits used by the registered triage query (parameters of triage())
TRIAGE_LIMITS = TR.Limits(max_file_bytes=1000, max_pages=50)
MONTH_LIMIT = 600
JOB_TIMEOUT = 2 * 24 * 3600


@register("file_triage", "TRI-1..6 on files derived from part (SRC-3 bytes)", f"""
WITH f AS (
  SELECT p_partkey AS doc_id,
         CASE WHEN p_partkey % 11 = 0 THEN 5 ELSE 9 END
           + 12 * p_size * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END + 13
           + CASE WHEN p_partkey % 13 = 0 THEN 8 ELSE 0 END AS size,
         p_size * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS est_pages,
         p_partkey % 11 <> 0 AS is_pdf, p_partkey % 13 = 0 AS encrypted
  FROM part)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(greatest(est_pages, 1) AS BIGINT) AS est_pages,
       encrypted,
       CASE WHEN size > {TRIAGE_LIMITS.max_file_bytes} THEN 'SIZE_LIMIT_ERROR'
            WHEN NOT is_pdf THEN 'FILE_ERROR'
            WHEN est_pages > {TRIAGE_LIMITS.max_pages} THEN 'PAGE_LIMIT_ERROR'
            WHEN encrypted THEN 'SECURITY_ERROR' ELSE 'OK' END AS status
FROM f""")
def file_triage(spark, sf_dir):
    return (TR.triage(part_files(table(spark, sf_dir, "part")), TRIAGE_LIMITS)
            .select("doc_id", "size", "est_pages", "encrypted", "status"))


@register("triage_summary", "TRI-6 pass/quarantine split counts", f"""
SELECT status, count(*) AS files FROM (
  SELECT CASE WHEN length(t) > {TRIAGE_LIMITS.max_file_bytes} THEN 'SIZE_LIMIT_ERROR'
              WHEN substr(t, 1, 4) <> '%PDF' THEN 'FILE_ERROR'
              WHEN greatest(len(regexp_extract_all(t, '/Type[\\t\\n\\x0B\\f\\r \\x{{A0}}]*/Page[^s]', 0)), 1)
                   > {TRIAGE_LIMITS.max_pages} THEN 'PAGE_LIMIT_ERROR'
              WHEN instr(t, '/Encrypt') > 0 THEN 'SECURITY_ERROR' ELSE 'OK' END AS status
  FROM (SELECT {file_text('duck')} AS t FROM part)) GROUP BY status""")
def triage_summary(spark, sf_dir):
    t = TR.triage(part_files(table(spark, sf_dir, "part")), TRIAGE_LIMITS)
    ok, bad = TR.pass_quarantine(t)
    return (ok.unionByName(bad).groupBy("status")
            .agg(F.count(F.lit(1)).cast("long").alias("files")))


@register("object_events", "SRC-1/2 records with decoded keys, SNK-2 result locations", """
SELECT source AS bucket, raw_key, key, n_chars AS size, 'ObjectCreated:Put' AS event_name,
       CASE WHEN key IS NULL THEN 'KEY_ERROR' ELSE 'OK' END AS status, source AS output_bucket,
       'processed/' || regexp_replace(key, '\\.[^/.]+\\z', '') || '-result.json' AS output_key
FROM (SELECT source, n_chars, raw_key, url_decode(replace(raw_key, '+', ' ')) AS key
      FROM (SELECT source, n_chars, 'in+put/' || lang || '%2F' || CAST(doc_id AS VARCHAR) || '.v1.pdf'
                   AS raw_key FROM documents))""")
def object_events(spark, sf_dir):
    recs = event_records(document_events(table(spark, sf_dir, "documents")))
    return (result_location(recs)
            .select("bucket", "raw_key", "key", "size", "event_name", "status", "output_bucket",
                    "output_key"))


USAGE_SQL = """
WITH cnt AS (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY l_orderkey),
u AS (SELECT o_orderkey AS file_id, o_orderdate AS ts, CAST(coalesce(cnt.pages, 0) AS BIGINT) AS pages,
             strftime(o_orderdate, 'USAGE#%Y#%m') AS month
      FROM orders LEFT JOIN cnt ON cnt.l_orderkey = orders.o_orderkey)"""


@register("usage_monthly", "AGG-14 monthly pages, files, last update", USAGE_SQL + """
SELECT month, CAST(sum(pages) AS BIGINT) AS total_pages, count(*) AS total_files,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '.'
         || lpad(CAST(millisecond(max(ts)) % 1000 AS VARCHAR), 3, '0') || 'Z' AS last_updated
FROM u GROUP BY month""")
def usage_monthly(spark, sf_dir):
    return U.usage_monthly(DV.order_usage(table(spark, sf_dir, "orders"),
                                          table(spark, sf_dir, "lineitem")))


@register("quota_flags", "WIN-4 month-to-date quota check (two-level running sum)", USAGE_SQL + f"""
SELECT file_id, month, pages, prior_pages,
       CASE WHEN prior_pages + pages > {MONTH_LIMIT} THEN 'QUOTA_EXCEEDED'
            WHEN prior_pages + pages > {MONTH_LIMIT} * {U.WARN_SHARE} THEN 'WARNING' ELSE 'OK' END AS status
FROM (SELECT *, CAST(coalesce(sum(pages) OVER (PARTITION BY month ORDER BY ts, file_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_pages FROM u)""")
def quota_flags(spark, sf_dir):
    return U.quota_flags(DV.order_usage(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")),
                         limit=MONTH_LIMIT)


@register("error_counts", "AGG-16 errors by type (fallback PROCESSING_ERROR)", f"""
SELECT coalesce({DV.ERROR_TYPE_SQL}, 'PROCESSING_ERROR') AS error_type, count(*) AS error_count
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def error_counts(spark, sf_dir):
    return M.error_counts(DV.run_errors(table(spark, sf_dir, "events")))


@register("retryable_errors", "PRJ-7 retryable classification", f"""
SELECT event_id, {DV.ERROR_NAME_SQL} AS error_name,
       ({DV.ERROR_NAME_SQL}) IN ('ThrottlingException', 'ServiceUnavailableException', 'InternalServerError')
         OR coalesce({DV.RETRY_FLAG_SQL}, false) AS retryable
FROM events WHERE event_type = 'error'""")
def retryable_errors(spark, sf_dir):
    return (M.retryable(DV.run_errors(table(spark, sf_dir, "events")))
            .select("event_id", "error_name", "retryable"))


@register("latency_metrics", "AGG-15 processing time by engine and page count", f"""
SELECT {DV.ENGINE_SQL} AS engine, CAST(user_id % 10 + 1 AS INTEGER) AS page_count, count(*) AS n,
       {round6_sql('sum(value)')} AS sum_ms, min(value) AS min_ms, max(value) AS max_ms,
       {round6_sql('avg(value)')} AS avg_ms
FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def latency_metrics(spark, sf_dir):
    return (M.latency_metrics(DV.run_times(table(spark, sf_dir, "events")))
            .withColumn("sum_ms", round6("sum_ms")).withColumn("avg_ms", round6("avg_ms")))


@register("latency_quantiles", "AGG-15 quantiles by engine and page count: exact, and whether a sketch's lie within 0.1 % of their ranks", f"""
SELECT engine, page_count, CAST(q.q AS DOUBLE) AS q, n, {round6_sql('list_extract(v, q.i)')} AS value, true AS within
FROM (SELECT {DV.ENGINE_SQL} AS engine, CAST(user_id % 10 + 1 AS INTEGER) AS page_count, count(*) AS n, quantile_cont(value, [0.5, 0.9, 0.99]) AS v
      FROM events WHERE event_type <> 'error' GROUP BY ALL) CROSS JOIN (SELECT unnest([0.5, 0.9, 0.99]) AS q, unnest([1, 2, 3]) AS i) q""")
def latency_quantiles(spark, sf_dir):
    runs, by = DV.run_times(table(spark, sf_dir, "events")), ["engine", "page_count"]
    got = (M.latency_metrics(runs, quantiles=True)
           .select(*by, "n", F.posexplode("p50_p90_p99").alias("k", "v"))
           .withColumn("q", F.element_at(F.array(*[F.lit(x) for x in M.QUANTILES]), F.col("k") + 1)).drop("k"))
    close = M.within_rank(runs, got, by, 0.001).drop("v", "n")
    return M.latency_percentiles(runs).withColumn("value", round6("value")).join(close, [*by, "q"])


@register("latency_sketch_months", "AGG-15 / STR-3: a month's quantiles by engine from its days' merged sketches, within 1.5 % of ranks; n and exact values beside", f"""
SELECT month, engine, CAST(q.q AS DOUBLE) AS q, n, days, {round6_sql('list_extract(v, q.i)')} AS value, true AS within
FROM (SELECT strftime(ts, '%Y-%m') AS month, {DV.ENGINE_SQL} AS engine, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, quantile_cont(value, [0.5, 0.9, 0.99]) AS v
      FROM events WHERE event_type <> 'error' GROUP BY ALL) CROSS JOIN (SELECT unnest([0.5, 0.9, 0.99]) AS q, unnest([1, 2, 3]) AS i) q""")
def latency_sketch_months(spark, sf_dir):
    runs, by = DV.run_times(table(spark, sf_dir, "events")), ["month", "engine"]
    runs = runs.withColumn("month", F.date_format("ts", "yyyy-MM"))
    stored = materialize(M.latency_sketches(runs).withColumn("month", F.date_format("start", "yyyy-MM")), "latency-days")
    merged = M.merge_sketches(stored, by)
    close = M.within_rank(runs, M.sketch_quantiles(merged), by, 0.015).drop("v")
    days = stored.groupBy(*by).agg(F.count_distinct("start").alias("days"))
    exact = M.latency_percentiles(runs, tuple(by)).withColumn("value", round6("value")).drop("n")
    return close.join(exact, [*by, "q"]).join(days, by)


@register("throughput", "AGG-13 total seconds and seconds per page", f"""
SELECT engine, {round6_sql('total_seconds')} AS total_seconds, pages,
       {round6_sql('total_seconds / pages')} AS seconds_per_page
FROM (SELECT {DV.ENGINE_SQL} AS engine, sum(value) / 1000 AS total_seconds,
             CAST(sum(user_id % 10 + 1) AS BIGINT) AS pages
      FROM events WHERE event_type <> 'error' GROUP BY ALL)""")
def throughput(spark, sf_dir):
    t = M.throughput(DV.run_times(table(spark, sf_dir, "events")))
    return t.select("engine", round6("total_seconds").alias("total_seconds"), "pages",
                    round6("seconds_per_page").alias("seconds_per_page"))


@register("job_outcomes", "PRJ-6 job completion / failure / timeout from a status log", f"""
WITH s AS (SELECT user_id AS job_id, ts, event_id AS seq, {DV.STATUS_SQL} AS status,
                  'event ' || CAST(event_id AS VARCHAR) AS message FROM events),
g AS (SELECT job_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n_events,
             arg_min(struct_pack(ts := ts, status := status, message := message), (ts, seq))
               FILTER (WHERE status IN ('SUCCEEDED', 'FAILED')) AS t
      FROM s GROUP BY job_id)
SELECT job_id, n_events,
       CASE WHEN job_id IS NULL THEN 'MISSING_JOB_ID'
            WHEN t IS NOT NULL AND epoch_us(t.ts) - epoch_us(started) < {JOB_TIMEOUT * 1_000_000} THEN t.status
            WHEN t IS NOT NULL OR epoch_us(last_seen) - epoch_us(started) >= {JOB_TIMEOUT * 1_000_000}
              THEN 'TIMEOUT_ERROR'
            ELSE 'IN_PROGRESS' END AS outcome,
       CASE WHEN t IS NOT NULL AND epoch_us(t.ts) - epoch_us(started) < {JOB_TIMEOUT * 1_000_000}
             AND t.status = 'FAILED' THEN t.message END AS error_message
FROM g""")
def job_outcomes(spark, sf_dir):
    return M.job_outcomes(DV.job_status_log(table(spark, sf_dir, "events")), JOB_TIMEOUT)


@register("quota_admission", "WIN-5 greedy admission: rejected files use no quota", USAGE_SQL.replace(
    "WITH cnt", "WITH RECURSIVE cnt") + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, file_id) AS rn FROM u),
r AS (
  SELECT month, rn, file_id, pages, CAST(0 AS BIGINT) AS used_before,
         CASE WHEN pages > {MONTH_LIMIT} THEN 'QUOTA_EXCEEDED'
              WHEN pages > {MONTH_LIMIT} * {U.WARN_SHARE} THEN 'WARNING' ELSE 'OK' END AS status,
         CAST(CASE WHEN pages > {MONTH_LIMIT} THEN 0 ELSE pages END AS BIGINT) AS used_after
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.month, o.rn, o.file_id, o.pages, r.used_after,
         CASE WHEN r.used_after + o.pages > {MONTH_LIMIT} THEN 'QUOTA_EXCEEDED'
              WHEN r.used_after + o.pages > {MONTH_LIMIT} * {U.WARN_SHARE} THEN 'WARNING' ELSE 'OK' END,
         CASE WHEN r.used_after + o.pages > {MONTH_LIMIT} THEN r.used_after ELSE r.used_after + o.pages END
  FROM r JOIN o ON o.month = r.month AND o.rn = r.rn + 1)
SELECT file_id, month, pages, used_before, status FROM r""")
def quota_admission(spark, sf_dir):
    return U.admit(DV.order_usage(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")),
                   limit=MONTH_LIMIT)


@register("log_errors", "SRC-6 structured log lines parsed and counted per hour", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, 'S3 OCR processing failed' AS message,
       count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def log_errors(spark, sf_dir):
    return LG.log_errors(LG.parse_logs(LG.event_log_lines(table(spark, sf_dir, "events"))))
