"""Streams give the batch answers (STR-1..4)."""

import os
import tempfile

from pyspark.sql import functions as F

from sheaf.operators import assemble as A
from sheaf.operators import metrics as M
from sheaf.sources import derived as DV
from sheaf.sources.blocks import stored, to_responses, write_responses
from sheaf.sources.tables import table
from sheaf.streaming.assembly import read_results, read_status, start_assembly_stream
from sheaf.streaming.counters import job_tracker, metrics_counter, usage_counter

SF = "/root/testdata/sf0.001"


def _summary(docs):
    return sorted((r.doc_id, r.pageCount, r.n_forms, r.texts) for r in docs.select(
        "doc_id", "pageCount", F.size("forms").alias("n_forms"),
        F.concat_ws("|", F.transform("pages", lambda p: p["text"])).alias("texts")).collect())


def test_assembly_stream_waits_for_all_chunks(spark):
    orders = table(spark, SF, "orders").filter("o_orderkey < 60")
    blocks = DV.order_blocks(orders, table(spark, SF, "lineitem").filter("l_orderkey < 60"))
    resp = to_responses(blocks)
    root = tempfile.mkdtemp(prefix="sheaf-str1-")
    src, out, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    # first only chunk 0 lands: multi-chunk documents must wait
    write_responses(resp.filter("chunk_no = 0"), src)
    start_assembly_stream(spark, src, out, ckpt).awaitTermination()
    first = read_results(spark, f"{out}/results")
    single = resp.groupBy("doc_id").agg(F.max("chunk_no").alias("m")).filter("m = 0").count()
    assert first.count() == single
    waiting = {r.status: r["count"] for r in read_status(spark, out).groupBy("status").count().collect()}
    assert waiting == {"PROCESSED": single, "INCOMPLETE": resp.select("doc_id").distinct().count() - single}
    # the rest lands in a later batch (append into the same folder)
    write_responses(resp.filter("chunk_no > 0"), src, mode="append")
    start_assembly_stream(spark, src, out, ckpt).awaitTermination()
    got = _summary(read_results(spark, f"{out}/results"))
    want = _summary(A.assemble(blocks))
    assert got == want
    assert {r.status for r in read_status(spark, out).collect()} == {"PROCESSED"}


def test_failed_and_damaged_documents_have_a_status_and_no_result(spark):
    orders, lines = table(spark, SF, "orders"), table(spark, SF, "lineitem")
    rows = DV.order_responses(orders, lines)
    root = tempfile.mkdtemp(prefix="sheaf-str1b-")
    src, out, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    from sheaf.sources.blocks import folder, parse_responses, response_status
    rows.withColumn("part", folder(F.col("doc_id"))).write.partitionBy("part").json(src)
    start_assembly_stream(spark, src, out, ckpt).awaitTermination()
    want = {r.doc_id: r.status.replace("READY", "PROCESSED") for r in response_status(parse_responses(rows)).collect()}
    assert {r.doc_id: r.status for r in read_status(spark, out).collect()} == want
    done = {r.doc_id for r in read_results(spark, f"{out}/results").collect()}
    assert done == {d for d, s in want.items() if s == "PROCESSED"}


def test_only_touched_folders_are_read(spark):
    from sheaf.sources.blocks import read_responses
    orders = table(spark, SF, "orders").filter("o_orderkey < 200")
    resp = to_responses(DV.order_blocks(orders, table(spark, SF, "lineitem").filter("l_orderkey < 200")))
    src = os.path.join(tempfile.mkdtemp(prefix="sheaf-prune-"), "in")
    write_responses(resp, src)
    parts = sorted({r.part for r in stored(resp).select("part").collect()})[:2]
    read = read_responses(spark, src, parts=parts)
    assert {f.rsplit("/", 2)[1] for f in read.inputFiles()} == {f"part={p}" for p in parts}
    assert read_responses(spark, src, parts=[9999]).count() == 0


def test_usage_counter_matches_batch(spark):
    usage = DV.order_usage(table(spark, SF, "orders"), table(spark, SF, "lineitem"))
    root = tempfile.mkdtemp(prefix="sheaf-str2-")
    usage.repartition(4, "file_id").write.parquet(os.path.join(root, "u"))
    stream = (spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(root, "u")))
    q = (usage_counter(stream).writeStream.outputMode("complete").format("memory")
         .queryName("usage_days").start())
    q.processAllAvailable()
    q.stop()
    got = {r.month: (r.p, r.f) for r in spark.sql(
        "SELECT month, sum(pages) p, sum(files) f FROM usage_days GROUP BY month").collect()}
    from sheaf.operators.usage import usage_monthly
    want = {r.month: (r.total_pages, r.total_files) for r in usage_monthly(usage).collect()}
    assert got == want


def test_metrics_counter_matches_batch(spark):
    ev = table(spark, SF, "events")
    root = tempfile.mkdtemp(prefix="sheaf-str3-")
    ev.write.parquet(os.path.join(root, "e"))
    s = spark.readStream.schema(ev.schema).parquet(os.path.join(root, "e"))
    lat, err = metrics_counter(DV.run_times(s), DV.run_errors(s))
    q = err.writeStream.outputMode("complete").format("memory").queryName("err_w").start()
    q.processAllAvailable()
    q.stop()
    got = {r.error_type: r.n for r in spark.sql(
        "SELECT error_type, sum(n) n FROM err_w GROUP BY error_type").collect()}
    want = {r.error_type: r.error_count for r in M.error_counts(DV.run_errors(ev)).collect()}
    assert got == want
    q = lat.writeStream.outputMode("complete").format("memory").queryName("lat_w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.engine, r.page_count): (r.n, round(r.s, 4), r.m) for r in spark.sql(
        "SELECT engine, page_count, sum(n) n, sum(sum_ms) s, max(max_ms) m FROM lat_w GROUP BY 1, 2").collect()}
    want = {(r.engine, r.page_count): (r.n, round(r.sum_ms, 4), r.max_ms) for r in M.latency_metrics(DV.run_times(ev)).collect()}
    assert got == want


def test_job_tracker_agrees_with_batch(spark):
    import datetime as dt

    from sheaf.streaming.counters import missing_job_ids
    ev = table(spark, SF, "events")
    t0 = ev.agg(F.min("ts")).first()[0]
    extra = [(None, t0, 1, "SUCCEEDED", "no id"), (None, t0, 2, "FAILED", "no id"), (10 ** 6, t0, 3, "IN_PROGRESS", "silent")]
    log = DV.job_status_log(ev)
    log = log.unionByName(spark.createDataFrame(extra, "job_id long, ts timestamp, seq long, status string, message string")
                          .withColumn("ts", F.col("ts").cast(log.schema["ts"].dataType)).select(*[F.col(f.name).cast(f.dataType) for f in log.schema]))
    root = tempfile.mkdtemp(prefix="sheaf-str4-")
    # land the log in time order, several files, so the watermark advances;
    # a job far in the future moves it past every limit
    day = F.date_format("ts", "yyyyMMdd")
    for i, d in enumerate(sorted(r.d for r in log.select(day.alias("d")).distinct().collect())):
        log.filter(day == d).coalesce(1).write.mode("append").parquet(os.path.join(root, "log"))
    end = log.agg(F.max("ts")).first()[0]
    timeout = 2 * 24 * 3600
    for days in (30, 60):
        late = [(-1, end + dt.timedelta(days=days), 0, "IN_PROGRESS", "clock")]
        (spark.createDataFrame(late, "job_id long, ts timestamp, seq long, status string, message string")
         .select(*[F.col(f.name).cast(f.dataType) for f in log.schema]).coalesce(1).write.mode("append").parquet(os.path.join(root, "log")))
    s = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
         .parquet(os.path.join(root, "log")))
    q = (job_tracker(s, timeout).writeStream.outputMode("append").format("memory")
         .queryName("jobs_out").start())
    q.processAllAvailable()
    q.stop()
    rows = [r for r in spark.sql("SELECT * FROM jobs_out").collect() if r.job_id != -1]
    got = {r.job_id: (r.outcome, r.error_message) for r in rows}
    assert len(got) == len(rows), "a job was decided twice"
    want = {r.job_id: (r.outcome, r.error_message) for r in M.job_outcomes(log, timeout, as_of=end + dt.timedelta(days=30)).collect()}
    missing = want.pop(None)
    assert got == want and got[10 ** 6][0] == "TIMEOUT_ERROR" and missing[0] == "MISSING_JOB_ID"
    q = missing_job_ids(s).writeStream.outputMode("complete").format("memory").queryName("no_ids").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.outcome, r.n_events) for r in spark.sql("SELECT * FROM no_ids").collect()] == [("MISSING_JOB_ID", 2)]


def test_running_monthly_usage_equals_batch_over_all_months(spark):
    from sheaf.operators.usage import usage_monthly
    from sheaf.streaming.counters import monthly_usage_counter
    usage = DV.order_usage(table(spark, SF, "orders"), table(spark, SF, "lineitem"))
    root = tempfile.mkdtemp(prefix="sheaf-str2m-")
    usage.repartition(4, "file_id").write.parquet(os.path.join(root, "u"))
    s = (spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1)
         .parquet(os.path.join(root, "u")))
    q = (monthly_usage_counter(s).writeStream.outputMode("complete").format("memory")
         .queryName("usage_months").start())
    q.processAllAvailable()
    q.stop()
    key = lambda rows: {r.month: (r.total_pages, r.total_files, r.last_updated) for r in rows}
    assert key(spark.sql("SELECT * FROM usage_months").collect()) == key(usage_monthly(usage).collect())
