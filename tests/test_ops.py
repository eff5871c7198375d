"""Triage, events, usage and admission."""

from pyspark.sql import functions as F

from sheaf.operators import triage as TR
from sheaf.operators import usage as U
from sheaf.sources.events import event_records, result_location


SF = "/root/testdata/sf0.001"


def test_triage_first_failure_wins(spark):
    rows = [
        ("big", bytearray(b"%PDF" + b"x" * 80)),
        ("zip", bytearray(b"PK..\n/Type /Page\n")),
        ("many", bytearray(b"%PDF-1.4\n" + b"/Type /Page\n" * 3 + b"/Type /Pages\n")),
        ("enc", bytearray(b"%PDF-1.4\n/Type /Page\n/Encrypt")),
        ("ok", bytearray(b"%PDF-1.4\n/Type /Pages\n")),
    ]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("length", F.lit(None).cast("long"))
    got = {r.path: (r.status, r.est_pages) for r in TR.triage(df, TR.Limits(max_file_bytes=60, max_pages=2)).collect()}
    assert got["big"][0] == "SIZE_LIMIT_ERROR"
    assert got["zip"][0] == "FILE_ERROR"
    assert got["many"] == ("PAGE_LIMIT_ERROR", 3)
    assert got["enc"][0] == "SECURITY_ERROR"
    assert got["ok"] == ("OK", 1)   # '/Pages' is not a page; none found -> 1


def test_event_key_decoding_and_output_key(spark):
    rec = [{"s3": {"bucket": {"name": "b"}, "object": {"key": k, "size": None}},
            "eventName": "ObjectCreated:Put"} for k in ["a+b%2Bc%20d.pdf", "dir.v1/noext", "bad%zz.pdf"]]
    import json
    from sheaf.sources.events import EVENT
    ev = spark.read.schema(EVENT).json(spark.sparkContext.parallelize([json.dumps({"Records": rec})]))
    out = {r.raw_key: r for r in result_location(event_records(ev), None).collect()}
    assert out["a+b%2Bc%20d.pdf"].key == "a b+c d.pdf"
    assert out["a+b%2Bc%20d.pdf"].output_key == "processed/a b+c d-result.json"
    assert out["dir.v1/noext"].output_key == "processed/dir.v1/noext-result.json"
    assert out["bad%zz.pdf"].status == "KEY_ERROR"
    assert out["a+b%2Bc%20d.pdf"].size == 0


def test_admission_chunks_compose_like_a_fold(spark):
    import datetime as dt
    import random
    rnd = random.Random(7)
    rows = [(i, dt.datetime(2024, 1 + i % 2, 1) + dt.timedelta(minutes=rnd.randrange(40000)),
             rnd.randrange(0, 40)) for i in range(400)]
    usage = spark.createDataFrame(rows, "file_id long, ts timestamp, pages long")
    got = {r.file_id: (r.status, r.used_before) for r in U.admit(usage, limit=300, chunks=9).collect()}
    want, used = {}, {}
    for fid, ts, p in sorted(rows, key=lambda r: (r[1], r[0])):
        m = ts.strftime("%Y%m")
        u = used.get(m, 0)
        if u + p > 300:
            want[fid] = ("QUOTA_EXCEEDED", u)
        else:
            want[fid] = ("WARNING" if u + p > 240 else "OK", u)
            used[m] = u + p
    assert got == want


def test_job_outcomes_missing_id_and_timeout(spark):
    import datetime as dt
    from sheaf.operators import metrics as M
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 1, "IN_PROGRESS", "m1"), (1, t0 + dt.timedelta(seconds=100), 2, "FAILED", "boom"),
            (2, t0, 3, "IN_PROGRESS", "m3"), (2, t0 + dt.timedelta(seconds=900), 4, "SUCCEEDED", "ok"),
            (3, t0, 5, "IN_PROGRESS", "m5"),
            (None, t0, 6, "SUCCEEDED", "x")]
    log = spark.createDataFrame(rows, "job_id long, ts timestamp, seq long, status string, message string")
    got = {r.job_id: (r.outcome, r.error_message) for r in M.job_outcomes(log, 300).collect()}
    assert got == {1: ("FAILED", "boom"), 2: ("TIMEOUT_ERROR", None), 3: ("IN_PROGRESS", None),
                   None: ("MISSING_JOB_ID", None)}


def test_job_limit_is_exclusive_and_as_of_judges_silent_jobs(spark):
    import datetime as dt
    from sheaf.operators import metrics as M
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 1, "IN_PROGRESS", "m"), (1, t0 + dt.timedelta(seconds=300), 2, "SUCCEEDED", "m"),
            (2, t0, 3, "IN_PROGRESS", "m"), (2, t0 + dt.timedelta(seconds=299), 4, "SUCCEEDED", "m"), (3, t0, 5, "IN_PROGRESS", "m")]
    log = spark.createDataFrame(rows, "job_id long, ts timestamp, seq long, status string, message string")
    assert {r.job_id: r.outcome for r in M.job_outcomes(log, 300).collect()} == {1: "TIMEOUT_ERROR", 2: "SUCCEEDED", 3: "IN_PROGRESS"}
    later = {r.job_id: r.outcome for r in M.job_outcomes(log, 300, as_of=t0 + dt.timedelta(seconds=300)).collect()}
    assert later == {1: "TIMEOUT_ERROR", 2: "SUCCEEDED", 3: "TIMEOUT_ERROR"}


def test_files_are_judged_by_their_bytes_and_sizes_first(spark):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="sheaf-files-")
    for name, raw in (("a.pdf", b"%PDF-1.4 /Type /Page "), ("b.PDF", b"%PDF x"), ("c", b"%PDF y"), ("d.txt", b"hello"), ("big.pdf", b"%PDF" + b"z" * 200)):
        with open(os.path.join(d, name), "wb") as f:
            f.write(raw)
    got = {os.path.basename(r.path): r.status for r in TR.triage_path(spark, d, TR.Limits(max_file_bytes=100)).collect()}
    assert got == {"a.pdf": "OK", "b.PDF": "OK", "c": "OK", "d.txt": "FILE_ERROR", "big.pdf": "SIZE_LIMIT_ERROR"}
    plan = TR.read_files(spark, d).filter("length <= 100")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan


def test_mb_text(spark):
    from sheaf.sinks.results import mb_text
    df = spark.createDataFrame([(0,), (1048576,), (1572864,), (10 * 1024 * 1024 + 1,)], "b long").select(mb_text(TR.F.col("b"), 2).alias("t"))
    assert [r.t for r in df.collect()] == ["0.00MB", "1.00MB", "1.50MB", "10.00MB"]


def test_read_logs_from_files(spark):
    import json
    import os
    import tempfile
    from sheaf.sources.logs import log_errors, read_logs
    d = tempfile.mkdtemp(prefix="sheaf-logs-")
    lines = [json.dumps({"timestamp": "2024-01-05T10:15:00.000Z", "level": "ERROR", "service": "s",
                         "version": "1", "requestId": "r1", "message": "S3 OCR processing failed",
                         "data": {"key": "a.pdf", "error": "x"}, "environment": "prod"}),
             "not json",
             json.dumps({"timestamp": "2024-01-05T10:45:00.000Z", "level": "error",
                         "message": "S3 OCR processing failed"}),
             json.dumps({"timestamp": "2024-01-05T11:00:00.000Z", "level": "INFO", "message": "done"})]
    with open(os.path.join(d, "log.jsonl"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    logs = read_logs(spark, d)
    assert logs.count() == 4
    first = logs.filter("requestId = 'r1'").first()
    assert json.loads(first.data) == {"key": "a.pdf", "error": "x"}
    got = [(r.hour, r.message, r.n) for r in log_errors(logs).collect()]
    assert got == [("2024-01-05 10:00", "S3 OCR processing failed", 2)]


def test_sketches_merge_and_follow_a_stream(spark):
    import os
    import tempfile

    from sheaf.operators import metrics as M
    from sheaf.sources import derived as DV
    from sheaf.sources.tables import table
    runs = DV.run_times(table(spark, SF, "events"))
    runs = runs.unionByName(runs.limit(3).withColumn("duration_ms", F.lit(None).cast("double")))
    path = os.path.join(tempfile.mkdtemp(prefix="sheaf-kll-"), "r")
    runs.repartition(3).write.parquet(path)
    s = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = M.latency_sketches(s).writeStream.outputMode("complete").format("memory").queryName("kll_days").start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM kll_days")
    batch = M.latency_sketches(runs)
    key = lambda df: sorted((r["start"], r["engine"], r["page_count"], r["n"]) for r in df.collect())
    assert key(streamed) == key(batch) and streamed.agg(F.sum("n")).first()[0] == runs.count() - 3
    every = runs.where("duration_ms is not null")
    for days in (streamed, batch):
        for by in (["engine"], ["engine", "page_count"]):
            found = M.sketch_quantiles(M.merge_sketches(days, by), (0.0, 0.1, 0.5, 0.9, 1.0))
            close = M.within_rank(every, found, by, 0.015).collect()
            assert len(close) == found.count() and all(r["within"] for r in close)
    assert M.merge_sketches(batch.where("false"), ["engine"]).count() == 0
    small = spark.createDataFrame([("e", 1, x) for x in (1.0, 2.0, 10.0, None)], "engine string, page_count int, duration_ms double")
    assert [(r["q"], r["n"], r["value"]) for r in M.latency_percentiles(small).orderBy("q").collect()] == [(0.5, 3, 2.0), (0.9, 3, 8.4), (0.99, 3, 9.84)]
