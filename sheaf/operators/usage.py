"""Monthly usage, quota checks and admission (AGG-14, WIN-4, WIN-5).

Usage rows: ``(file_id, ts, pages)``.  Month keys are ``USAGE#yyyy#MM``
(session time zone UTC).

The quota check (WIN-4) is a running sum inside a month and admission
(WIN-5) a fold inside a month.  A month (or an hour of it) can hold a large
share of all files, so both run over balanced chunks of a range partitioning
on the unique key (month, ts, file_id), combined per month through a small
months x chunks table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# FIXED VALUES: monthly page quota default and the warning share
MAX_PAGES_PER_MONTH = 1000
WARN_SHARE = 0.8

CHUNK_ROWS = 100_000


def month_key(ts) -> F.Column:
    return F.date_format(ts, "'USAGE#'yyyy'#'MM")


def usage_monthly(usage: DataFrame) -> DataFrame:
    """AGG-14: pages added, files counted and last update per month."""
    return (usage.groupBy(month_key("ts").alias("month"))
            .agg(F.sum("pages").cast("long").alias("total_pages"),
                 F.count(F.lit(1)).cast("long").alias("total_files"),
                 F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_updated")))


def ranged_usage(usage: DataFrame, chunks: int | None = None) -> DataFrame:
    """Usage rows range-partitioned on the unique key (month, ts, file_id)
    with the chunk (partition) number as a column, written once so both
    passes of a two-level scan see the same chunks.  Chunks are contiguous in
    month order and balanced however many files one month or hour holds; their
    number follows the rows, so a chunk stays about ``CHUNK_ROWS`` at most."""
    from sheaf.session import materialize
    spark = usage.sparkSession
    n = chunks or max(spark.sparkContext.defaultParallelism * 2, 1 + usage.count() // CHUNK_ROWS)
    u = usage.select("file_id", "ts", F.col("pages").cast("long").alias("pages"),
                     month_key("ts").alias("month"))
    return materialize(u.repartitionByRange(n, "month", "ts", "file_id")
                       .withColumn("chunk", F.spark_partition_id()), "usage-ranges")


def prior_usage(usage: DataFrame, chunks: int | None = None) -> DataFrame:
    """Pages used in the same month by files before each file (order: ts,
    then file id), in two levels: per-(month, chunk) sums and their prefix
    over the month (a months x chunks table), then the running sum inside
    each chunk.  No task sees more than one chunk."""
    r = ranged_usage(usage, chunks)
    sums = r.groupBy("month", "chunk").agg(F.sum("pages").alias("chunk_pages"))
    wb = Window.partitionBy("month").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("month", "chunk",
                          F.coalesce(F.sum("chunk_pages").over(wb), F.lit(0)).alias("offset"))
    wi = (Window.partitionBy("month", "chunk").orderBy("ts", "file_id")
          .rowsBetween(Window.unboundedPreceding, -1))
    inner = r.select("*", F.coalesce(F.sum("pages").over(wi), F.lit(0)).alias("inner"))
    # chunks are contiguous in month order: at most months + chunks rows
    return (inner.join(F.broadcast(offsets), ["month", "chunk"])
            .select("file_id", "ts", "pages", "month",
                    (F.col("offset") + F.col("inner")).cast("long").alias("prior_pages")))


def quota_flags(usage: DataFrame, limit: int = MAX_PAGES_PER_MONTH,
                warn_share: float = WARN_SHARE) -> DataFrame:
    """WIN-4: ``QUOTA_EXCEEDED`` when month-to-date + this file > limit;
    ``WARNING`` when > warn_share x limit; else ``OK``.  Every file counts
    toward the month (the check alone, without admission)."""
    p = prior_usage(usage)
    after = F.col("prior_pages") + F.col("pages")
    return p.select("file_id", "month", "pages", "prior_pages",
                    F.when(after > limit, "QUOTA_EXCEEDED")
                    .when(after > limit * warn_share, "WARNING").otherwise("OK").alias("status"))


# ---------------------------------------------------------------------------
# WIN-5: greedy admission (a rejected file does not use quota)
# ---------------------------------------------------------------------------

ADMIT_OUT = "file_id long, month string, pages long, used_before long, status string"
MAP = "month string, chunk int, breaks array<long>, slopes array<long>, shifts array<long>"
START = "month string, chunk int, start long"


def _runs(batch, keys: tuple[str, ...]) -> list[tuple[tuple, int, int]]:
    """(key, begin, end) of the runs of equal keys in a sorted batch."""
    import numpy as np
    columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    return [(tuple(batch[k][x].as_py() for k in keys), x, y) for x, y in zip(at, at[1:]) if y > x]


def _chunk_maps(ranged: DataFrame, limit: int) -> DataFrame:
    """The map of each (month, chunk), batch by batch over sorted rows."""
    def run(batches):
        import pyarrow as pa

        from sheaf.operators import translations as T
        key, maps = None, []

        def row():
            f = T.compose(maps, limit)
            return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.string()), pa.array([key[0]], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in f)],
                                              names=["month", "chunk", "breaks", "slopes", "shifts"])

        for batch in batches:
            pages = batch["pages"].to_numpy(zero_copy_only=False)
            for own, x, y in _runs(batch, ("chunk", "month")):
                if own != key:
                    if maps:
                        yield row()
                    key, maps = own, []
                maps = [T.compose([*maps, T.of_files(pages[x:y], limit)], limit)]
        if maps:
            yield row()

    return _in_order(ranged).select("month", "chunk", "pages").mapInArrow(run, MAP)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("chunk", "month", "ts", "file_id")


def _starts(maps: DataFrame, chunks: int, limit: int, fan: int) -> DataFrame:
    """What is used at the start of each (month, chunk): up a tree of composed
    maps, ``fan`` to a node, and down again from 0 at the top; no task sees more
    than ``fan`` maps of a month."""
    import pyarrow as pa

    from sheaf.operators import translations as T

    def sorted_maps(table: pa.Table) -> tuple[pa.Table, list]:
        table = table.sort_by("chunk")
        return table, list(zip(*([x.values.to_numpy() for x in table[c]] for c in ("breaks", "slopes", "shifts"))))

    def compose(table: pa.Table) -> pa.Table:
        table, own = sorted_maps(table)
        f = T.compose(own, limit)
        return pa.table([table["month"][:1], pa.array([table["chunk"][0].as_py() // fan], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in f)],
                        names=["month", "chunk", "breaks", "slopes", "shifts"])

    def walk(table: pa.Table) -> pa.Table:
        table, own = sorted_maps(table)
        used, out = table["start"][0].as_py(), []
        for f in own:
            out.append(used)
            used = T.value(f, used)
        return pa.table([table["month"], table["chunk"], pa.array(out, pa.int64())], names=["month", "chunk", "start"])

    if chunks <= fan:
        return maps.withColumn("start", F.lit(0).cast("long")).groupBy("month").applyInArrow(walk, START)
    node = F.expr(f"chunk div {fan}").cast("int")
    above = _starts(maps.groupBy("month", node.alias("node")).applyInArrow(compose, MAP), -(-chunks // fan), limit, fan)
    above = above.select(F.col("month").alias("of"), F.col("chunk").alias("node"), "start")
    down = maps.withColumn("at", node).join(above, F.col("month").eqNullSafe(F.col("of")) & (F.col("at") == F.col("node")))
    return down.select("month", "chunk", "breaks", "slopes", "shifts", "node", "start").groupBy("month", "node").applyInArrow(walk, START)


def admit(usage: DataFrame, limit: int = MAX_PAGES_PER_MONTH, warn_share: float = WARN_SHARE,
          chunks: int | None = None, fan: int = 64) -> DataFrame:
    """Files in month order (ts, file id) are admitted while they fit the
    month's remaining quota; a rejected file (``QUOTA_EXCEEDED``) leaves the
    quota unchanged.  ``WARNING``: admitted beyond ``warn_share`` x limit.
    A null page count is 0; rows without a time are a month of their own.

    The fold is sequential, so it runs in three steps without a group per month:

    1. range-partition the files on the unique key (month, ts, file_id):
       contiguous, balanced chunks even when one month holds most files;
    2. per (month, chunk) the map used-before -> used-after as a piecewise
       translation (``translations.py``), whose size follows its breakpoints
       and not the limit; the maps of a month are composed up a tree and its
       starts handed down;
    3. replay every chunk from its start.

    Steps 2 and 3 read a chunk's sorted rows batch by batch and carry the map
    or the running total from one batch to the next.
    """
    from sheaf.session import materialize
    n = chunks or max(usage.sparkSession.sparkContext.defaultParallelism * 2, 1 + usage.count() // CHUNK_ROWS)
    ranged = ranged_usage(usage, n).withColumn("pages", F.coalesce("pages", F.lit(0)).cast("long"))
    maps = materialize(_chunk_maps(ranged, limit), "admission-maps")
    starts = _starts(maps, n, limit, fan)
    warn = limit * warn_share

    def replay(batches):
        import numpy as np
        import pyarrow as pa

        from sheaf.operators import translations as T
        key, used = None, 0
        for batch in batches:
            pages = batch["pages"].to_numpy(zero_copy_only=False)
            before, status = np.empty(len(pages), np.int64), np.empty(len(pages), object)
            for own, x, y in _runs(batch, ("chunk", "month")):
                if own != key:
                    key, used = own, batch["start"][x].as_py()
                before[x:y], admitted, used = T.replay(pages[x:y], used, limit)
                status[x:y] = np.where(admitted, np.where(before[x:y] + pages[x:y] > warn, "WARNING", "OK"), "QUOTA_EXCEEDED")
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["month"], batch["pages"], pa.array(before), pa.array(status, pa.string())],
                                             names=["file_id", "month", "pages", "used_before", "status"])

    # chunks are contiguous in month order: at most months + chunks rows
    at = F.broadcast(starts.select(F.col("month").alias("of"), F.col("chunk").alias("in"), "start"))
    rows = ranged.join(at, F.col("month").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("in")))
    return _in_order(rows).select("file_id", "month", "pages", "chunk", "start").mapInArrow(replay, ADMIT_OUT)
