"""Streaming counters (STR-2, STR-3, STR-4).

Every running aggregate carries a watermark so its state is bounded; the
reference has none (it posts single points), the watermark is ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.operators.metrics import JOB_TIMEOUT_SECONDS
from sheaf.operators.usage import month_key


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock (NTZ) columns are read as UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def usage_counter(usage: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-2: running pages/files per month, kept per day window so the
    watermark can retire finished days; monthly totals are the sum of the
    month's day rows (``month`` is a function of the window)."""
    return (event_time(usage).withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("day"), month_key("ts").alias("month"))
            .agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("files"),
                 F.max("ts").alias("last_ts")))


def metrics_counter(runs: DataFrame, errors: DataFrame, every: str = "1 minute",
                    delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """STR-3: latency by (window, engine, page count) and error counts by
    (window, error type)."""
    lat = (event_time(runs).withWatermark("ts", delay)
           .groupBy(F.window("ts", every).alias("w"), "engine", "page_count")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("sum_ms"),
                F.max("duration_ms").alias("max_ms")))
    err = (event_time(errors).withWatermark("ts", delay)
           .groupBy(F.window("ts", every).alias("w"),
                    F.coalesce("error_type", F.lit("PROCESSING_ERROR")).alias("error_type"))
           .agg(F.count(F.lit(1)).alias("n")))
    return lat, err


JOB_OUT = "job_id long, outcome string, error_message string, n_events long"
JOB_STATE = ("started long, t_ts long, t_seq long, t_status string, t_message string, "
             "n long, done boolean")


def job_tracker(status_log: DataFrame, timeout_s: int = JOB_TIMEOUT_SECONDS,
                delay: str = "1 hour", keep_s: int = 7 * 24 * 3600) -> DataFrame:
    """STR-4: per job, keep the start and the first terminal status in state;
    when the watermark passes start + limit, emit the outcome once (terminal
    before the limit, else ``TIMEOUT_ERROR``), as the batch decides at a later
    time (``job_outcomes`` with ``as_of``).  A decided job stays marked for
    ``keep_s`` seconds, so later rows of it do not start it again.  Rows
    without a job id are no job: see ``missing_job_ids``.

    State per job is a few fields; a job's rows per micro-batch are the only
    group data held at once."""
    limit_ms = timeout_s * 1000

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job_id,) = key
        started, t_ts, t_seq, t_status, t_msg, n, done = state.get if state.exists else (None, None, None, None, None, 0, False)
        if state.hasTimedOut:
            if done:
                state.remove()
                return
            ok = t_status is not None and t_ts - started < limit_ms * 1000
            state.update((started, t_ts, t_seq, t_status, t_msg, n, True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_s * 1000)
            yield pd.DataFrame({"job_id": [job_id], "outcome": [t_status if ok else "TIMEOUT_ERROR"],
                                "error_message": [t_msg if ok and t_status == "FAILED" else None], "n_events": [n]})
            return
        if done:
            for _ in pdfs:
                pass
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_s * 1000)
            return
        for pdf in pdfs:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            lo = int(us.min())
            started = lo if started is None else min(started, lo)
            n += len(pdf)
            term = pdf.assign(us=us)[pdf["status"].isin(["SUCCEEDED", "FAILED"])]
            if len(term):
                first = term.sort_values(["us", "seq"]).iloc[0]
                cand = (int(first["us"]), int(first["seq"]))
                if t_ts is None or cand < (t_ts, t_seq):
                    t_ts, t_seq = cand
                    t_status, t_msg = first["status"], first["message"]
        state.update((started, t_ts, t_seq, t_status, t_msg, n, False))
        # the timer may not lie behind the watermark (late jobs fire next batch)
        state.setTimeoutTimestamp(max(started // 1000 + limit_ms,
                                      state.getCurrentWatermarkMs() + 1))

    return (event_time(status_log.where("job_id is not null")).withWatermark("ts", delay)
            .groupBy("job_id")
            .applyInPandasWithState(step, JOB_OUT, JOB_STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def missing_job_ids(status_log: DataFrame) -> DataFrame:
    """STR-4: running count of rows without a job id (the batch's
    ``MISSING_JOB_ID`` row), a built-in aggregate of one row."""
    return (status_log.where("job_id is null").groupBy(F.lit("MISSING_JOB_ID").alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def monthly_usage_counter(usage: DataFrame) -> DataFrame:
    """STR-2: the running monthly total (pages, files, last update), updated as
    files arrive.  A built-in aggregate: rows are summed map-side, the state is
    one row a month (output mode update or complete)."""
    return (event_time(usage).groupBy(month_key("ts").alias("month"))
            .agg(F.sum("pages").alias("total_pages"), F.count(F.lit(1)).alias("total_files"),
                 F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_updated")))
