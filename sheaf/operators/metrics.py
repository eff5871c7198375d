"""Run metrics: errors, latency, throughput, job outcomes (AGG-13, AGG-15,
AGG-16, PRJ-6, PRJ-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: service errors that are retried, fallback error type,
# job time limit in seconds
RETRYABLE_ERRORS = ["ThrottlingException", "ServiceUnavailableException", "InternalServerError"]
FALLBACK_ERROR = "PROCESSING_ERROR"
LEGACY_FALLBACK_ERROR = "UNKNOWN_ERROR"
JOB_TIMEOUT_SECONDS = 300
QUANTILES = (0.5, 0.9, 0.99)


def error_counts(errors: DataFrame, fallback: str = FALLBACK_ERROR) -> DataFrame:
    """AGG-16: errors by type; a missing type falls back."""
    return (errors.groupBy(F.coalesce("error_type", F.lit(fallback)).alias("error_type"))
            .agg(F.count(F.lit(1)).cast("long").alias("error_count")))


def latency_metrics(runs: DataFrame, quantiles: bool = False) -> DataFrame:
    """AGG-15: processing time by engine and page count.  Quantiles use a
    bounded-memory sketch (``percentile_approx``)."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n"),
            F.sum("duration_ms").alias("sum_ms"),
            F.min("duration_ms").alias("min_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.avg("duration_ms").alias("avg_ms")]
    if quantiles:
        aggs += [F.percentile_approx("duration_ms", list(QUANTILES), 10000).alias("p50_p90_p99")]
    return runs.groupBy("engine", "page_count").agg(*aggs)


def latency_percentiles(runs: DataFrame, by: tuple[str, ...] = ("engine", "page_count"), qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """AGG-15: exact quantiles, interpolated between neighbours: ``(*by, q, n,
    value)``.  The aggregate holds a group's distinct values; where those are
    too many, use sketches."""
    g = runs.groupBy(*by).agg(F.count("duration_ms").alias("n"), F.percentile("duration_ms", list(qs)).alias("v"))
    return g.select(*by, "n", F.posexplode("v").alias("k", "value")).select(
        *by, F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("k") + 1).alias("q"), "n", "value")


def run_seconds(phases: DataFrame) -> DataFrame:
    """``(doc_id, conversion_s, shapes_s)`` from a log of ``(doc_id, phase,
    seconds)``: of a phase that ran again the longest time, NULL where a phase
    did not end."""
    return phases.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.max(F.when(F.col("phase") == p, F.col("seconds"))).alias(f"{p}_s") for p in ("conversion", "shapes")])


# KLL sketches: of k items a normalised rank is off by about 2.3 / k ** 0.9
SKETCH_K = 800


def latency_sketches(runs: DataFrame, window: str = "1 day", by: tuple[str, ...] = ("engine", "page_count"), k: int = SKETCH_K) -> DataFrame:
    """AGG-15 / STR-3: a mergeable sketch of processing times per time window
    and group: ``(start, *by, n, sketch)``, a few kilobytes a row, in a batch or
    a stream (with a watermark on ``ts``).  Missing times are left out."""
    g = runs.where("duration_ms is not null").groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w"), *by)
    rows = g.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(k)).alias("sketch"))
    return rows.select(F.col("w.start").alias("start"), *by, "n", "sketch")


def merge_sketches(sketches: DataFrame, by: list, k: int = SKETCH_K) -> DataFrame:
    """Stored sketches merged to coarser groups (columns ``by``): of days to
    months, of page counts to engines, or of all.  Only sketches are read."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``q`` and its estimate ``v`` of each row's sketch."""
    rest = [c for c in sketches.columns if c != "sketch"]
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("v")) for q in qs])
    return sketches.select(*rest, F.inline(pairs))


def within_rank(runs: DataFrame, found: DataFrame, by: list[str], error: float) -> DataFrame:
    """``found`` (*by, q, n, v) with ``within``: whether ``v`` lies within
    ``error`` x n (and one) ranks of its quantile among all rows of ``runs``."""
    ranks = (runs.join(found, by).groupBy(*by, "q", "n", "v")
             .agg(F.count_if(F.col("duration_ms") < F.col("v")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("v")).alias("up_to")))
    slack = F.lit(error) * F.col("n") + 1
    return ranks.select(*by, "q", "n", "v", ((F.col("below") <= F.col("q") * F.col("n") + slack) & (F.col("up_to") >= F.col("q") * F.col("n") - slack)).alias("within"))


def throughput(runs: DataFrame) -> DataFrame:
    """AGG-13: total seconds and seconds per page, per engine."""
    return (runs.groupBy("engine")
            .agg((F.sum("duration_ms") / 1000).alias("total_seconds"),
                 F.sum("page_count").cast("long").alias("pages"))
            .select("engine", "total_seconds", "pages",
                    (F.col("total_seconds") / F.col("pages")).alias("seconds_per_page")))


def retryable(errors: DataFrame) -> DataFrame:
    """PRJ-7: named service errors retry, else the error's own flag, else no."""
    return errors.select("*", (F.col("error_name").isin(*RETRYABLE_ERRORS)
                               | F.coalesce(F.col("retryable_flag"), F.lit(False))).alias("retryable"))


def job_outcomes(status_log: DataFrame, timeout_s: int = JOB_TIMEOUT_SECONDS, as_of=None) -> DataFrame:
    """PRJ-6: per job, the first terminal status (SUCCEEDED / FAILED) if it
    came in less than the time limit after the job's first event; otherwise
    ``TIMEOUT_ERROR`` once the limit is reached, else ``IN_PROGRESS``; rows
    without a job id are one ``MISSING_JOB_ID`` error row.  ``as_of`` (a
    timestamp column or literal) is the time at which silent jobs are judged;
    without it each job is judged at its own last event.
    ``status_log``: ``(job_id, ts, seq, status, message)``."""
    terminal = F.col("status").isin("SUCCEEDED", "FAILED")
    g = (status_log.groupBy("job_id")
         .agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"),
              F.min(F.when(terminal, F.struct("ts", "seq", "status", "message"))).alias("t"),
              F.count(F.lit(1)).cast("long").alias("n_events")))
    elapsed_t = F.unix_micros(F.col("t.ts").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    seen = F.col("last_seen") if as_of is None else F.greatest("last_seen", F.lit(as_of).cast(status_log.schema["ts"].dataType))
    elapsed_l = (F.unix_micros(seen.cast("timestamp"))
                 - F.unix_micros(F.col("started").cast("timestamp")))
    limit = F.lit(timeout_s * 1_000_000)
    outcome = (F.when(F.col("job_id").isNull(), F.lit("MISSING_JOB_ID"))
               .when(F.col("t").isNotNull() & (elapsed_t < limit), F.col("t.status"))
               .when(F.col("t").isNotNull() | (elapsed_l >= limit), F.lit("TIMEOUT_ERROR"))
               .otherwise(F.lit("IN_PROGRESS")))
    return g.select("job_id", "n_events", outcome.alias("outcome"),
                    F.when(outcome == "FAILED", F.col("t.message")).alias("error_message"))
