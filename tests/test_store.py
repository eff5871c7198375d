"""SNK-1: versioned result store; STR-1 and SRC-1 on it."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sheaf.sinks import store
from sheaf.sources.blocks import parse_responses, response_status, stored_schema
from sheaf.streaming import events as E
from sheaf.streaming.assembly import read_results, read_status, start_assembly_stream

SCHEMA = "doc_id long, v string"


@pytest.fixture
def path():
    return os.path.join(tempfile.mkdtemp(prefix="sheaf-store-"), "out")


def put(spark, path, rows, **kw):
    return store.append(spark.createDataFrame(rows, SCHEMA + (", _deleted boolean" if len(rows[0]) == 3 else "")) if rows else spark.createDataFrame([], SCHEMA), path, **kw)


def now(spark, path):
    return sorted((r.doc_id, r.v) for r in store.latest(spark, path).collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}


def test_latest_epoch_of_each_document_counts(spark, path):
    assert store.latest(spark, path, SCHEMA).collect() == []
    assert put(spark, path, [(1, "a"), (2, "a"), (3, None), (None, "n")]) == 0
    before = files(path)
    assert put(spark, path, [(2, "b"), (4, "b")]) == 1
    assert {f: t for f, t in files(path).items() if f in before} == before, "an earlier run's files were touched"
    assert put(spark, path, []) == 2
    assert put(spark, path, [(1, None, True), (4, "c", False), (4, "d", False)]) == 3  # 1 has no result any more, 4 comes twice
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.v) for r in store.latest(spark, path).collect())
    assert got == [(-1, "n"), (2, "b"), (3, None), (4, "d")]
    assert {r.doc_id for r in store.latest(spark, path, with_deleted=True).where("_deleted").collect()} == {1}


def test_a_killed_run_changes_nothing(spark, path):
    put(spark, path, [(1, "a"), (2, "a")])
    store.write_run(spark.createDataFrame([(1, "lost"), (9, "lost")], SCHEMA), path, 1)  # ended before its marker
    assert now(spark, path) == [(1, "a"), (2, "a")]
    put(spark, path, [(2, "b")])
    assert now(spark, path) == [(1, "a"), (2, "b")]
    store.compact(spark, path)
    assert now(spark, path) == [(1, "a"), (2, "b")]


def test_a_unit_of_work_is_committed_once(spark, path):
    assert put(spark, path, [(1, "a")], txn="q#7") == 0
    assert put(spark, path, [(1, "again")], txn="q#7") == 0
    assert put(spark, path, [(1, "b")], txn="q#8") == 1
    assert now(spark, path) == [(1, "b")] and len(store.commits(spark, path)) == 2


def test_compaction(spark, path):
    rows = {}
    for e in range(5):
        new = [(i, f"{e}") for i in range(e * 10, e * 10 + 40)] + [(1000 + e, "x")]
        put(spark, path, new)
        rows |= dict(new)
    put(spark, path, [(1000, None, True)])
    del rows[1000]
    reading = store.latest(spark, path)
    epoch = store.compact(spark, path, rows_per_file=30)
    assert epoch == 6 and now(spark, path) == sorted(rows.items())
    assert sorted(tuple(r) for r in reading.collect()) == sorted(rows.items()), "a reader under way lost its files"
    run = store.commits(spark, path)[-1]
    assert run.replaces and run.n_rows == len(rows)
    assert 2 <= len([f for f in os.listdir(f"{path}/data/run={run.run}") if f.startswith("part-")]) <= -(-len(rows) // 30)
    assert len(store.obsolete(spark, path)) == 6
    put(spark, path, [(5, "new", False), (1001, None, True)])
    rows |= {5: "new"}
    del rows[1001]
    assert now(spark, path) == sorted(rows.items())
    store.compact(spark, path)
    assert now(spark, path) == sorted(rows.items())


def body(status="SUCCEEDED", token=None, page=1, message=None):
    return json.dumps({k: v for k, v in {"JobStatus": status, "NextToken": token, "StatusMessage": message, "Blocks": [{"BlockType": "PAGE", "Id": f"p{page}", "Page": page}]}.items() if v is not None})


def land(src, n, rows, mtime=None):
    """Stored responses (doc_id, chunk_no, body) as file ``n``."""
    os.makedirs(f"{src}/part=0", exist_ok=True)
    f = f"{src}/part=0/f{n}.json"
    with open(f, "w") as out:
        out.writelines(json.dumps({"doc_id": d, "chunk_no": c, "body": b}) + "\n" for d, c, b in rows)
    if mtime:
        os.utime(f, (mtime, mtime))


def statuses(spark, out):
    return {r.doc_id: (r.status, r.status_message, r.n_chunks) for r in read_status(spark, out).collect()}


def batch(spark, src):
    rows = spark.read.schema(stored_schema()).json(src)
    return {r.doc_id: (r.status.replace("READY", "PROCESSED"), r.status_message, r.n_chunks) for r in response_status(parse_responses(rows)).collect()}


def test_stream_of_chunks_equals_batch_over_all_rows(spark):
    """Chunks in any order and batch, delivered again, differing, failed, damaged."""
    rng = random.Random(3)
    rows = []
    for d in range(60):
        n = rng.randrange(1, 4)
        own = [(d, c, body(token=None if c == n - 1 else "t", page=c + 1)) for c in range(n)]
        kind = d % 10
        if kind == 1:
            own += own
        elif kind == 2:
            own.append((d, n - 1, body(page=9)))
        elif kind == 3:
            own[-1] = (d, n - 1, body("FAILED", message=f"m{d}"))
        elif kind == 4:
            own[rng.randrange(n)] = (d, rng.randrange(n), rng.choice(["", None, "{cut", "{}"]))
        elif kind == 5:
            own.pop()
        elif kind == 6:
            own.append((d, n, body(page=n + 1)))
        elif kind == 7:
            own[-1] = (d, n - 1, body("IN_PROGRESS"))
        elif kind == 8:
            own.append((d, None, body()))
        rows += own
    rng.shuffle(rows)
    root = tempfile.mkdtemp(prefix="sheaf-tws-")
    src, out, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    third = len(rows) // 3
    land(src, 0, rows[:third])
    start_assembly_stream(spark, src, out, ckpt).awaitTermination()
    assert statuses(spark, out) == batch(spark, src)
    land(src, 1, rows[third:2 * third])
    land(src, 2, rows[2 * third:] + rows[:10])
    start_assembly_stream(spark, src, out, ckpt, max_files_per_trigger=1).awaitTermination()
    got = statuses(spark, out)
    assert got == batch(spark, src) and len({s for s, *_ in got.values()}) == 4
    done = {r.doc_id: r.pageCount for r in read_results(spark, f"{out}/results").collect()}
    assert done == {d: n for d, (s, _, n) in got.items() if s == "PROCESSED"}


def test_a_document_that_is_not_whole_in_time_is_timed_out(spark):
    root = tempfile.mkdtemp(prefix="sheaf-tws-t-")
    src, out, ckpt = (os.path.join(root, d) for d in ("in", "out", "ckpt"))
    clock = {"timeout_s": 100, "clock": F.col("_metadata.file_modification_time"), "max_files_per_trigger": 1}
    begin = 1_700_000_000
    land(src, 0, [(1, 0, body(token="t")), (2, 0, body()), (3, 0, body(token="t"))], begin)
    land(src, 1, [(3, 1, body(page=2)), (4, 0, body(token="t"))], begin + 50)
    start_assembly_stream(spark, src, out, ckpt, **clock).awaitTermination()
    assert {d: s for d, (s, *_) in statuses(spark, out).items()} == {1: "INCOMPLETE", 2: "PROCESSED", 3: "PROCESSED", 4: "INCOMPLETE"}
    land(src, 2, [(5, 0, body())], begin + 120)
    start_assembly_stream(spark, src, out, ckpt, **clock).awaitTermination()
    assert {d: s for d, (s, *_) in statuses(spark, out).items()} == {1: "TIMEOUT_ERROR", 2: "PROCESSED", 3: "PROCESSED", 4: "INCOMPLETE", 5: "PROCESSED"}
    land(src, 3, [(1, 1, body(page=2)), (4, 0, body(token="t"))], begin + 300)  # late, but whole; 4 only said again what it said
    start_assembly_stream(spark, src, out, ckpt, **clock).awaitTermination()
    assert {d: s for d, (s, *_) in statuses(spark, out).items()} == {1: "PROCESSED", 2: "PROCESSED", 3: "PROCESSED", 4: "TIMEOUT_ERROR", 5: "PROCESSED"}
    assert {r.doc_id: r.pageCount for r in read_results(spark, f"{out}/results").collect()} == {1: 2, 2: 1, 3: 2, 5: 1}


def record(key, minute, version=None):
    return {"eventName": "ObjectCreated:Put", "eventTime": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00.000Z",
            "s3": {"bucket": {"name": "b"}, "object": {"key": key, "size": 5} | ({"versionId": version} if version else {})}}


def test_event_stream_gives_the_batch_manifest(spark):
    """Repeated, late and unanswered events; keys that cannot be decoded."""
    from sheaf.plans.batch import document_id, run_batch
    from sheaf.sources.blocks import folder
    from sheaf.sources.events import EVENT
    root = tempfile.mkdtemp(prefix="sheaf-ev-")
    ev, st, out, ckpt, resp = (os.path.join(root, d) for d in ("ev", "st", "out", "ckpt", "resp"))
    os.makedirs(ev)
    os.makedirs(st)

    def events(n, *records):
        with open(f"{ev}/e{n}.json", "w") as f:
            f.write(json.dumps({"Records": list(records)}) + "\n")

    bodies = {"in/whole.pdf": body(), "in/failed.pdf": body("FAILED", message="no"), "in/cut.pdf": "{cut", "in/a b.pdf": body(), "in/late.pdf": body()}
    ids = {r.key: r.d for r in spark.createDataFrame([(k,) for k in [*bodies, "in/none.pdf"]], "key string").withColumn("d", document_id(F.lit("b"), F.col("key"))).collect()}
    events(0, record("in/whole.pdf", 0, "v1"), record("in/failed.pdf", 1), record("in/whole.pdf", 0, "v1"), record("bad%zz.pdf", 2))
    events(1, record("in/whole.pdf", 0, "v1"), record("in/cut.pdf", 3), record("in/a+b.pdf", 4), record("in/none.pdf", 5), record("in/whole.pdf", 6, "v2"))
    spark.createDataFrame([(ids[k], 0, b) for k, b in bodies.items()], "doc_id string, chunk_no int, body string").withColumn("part", folder(F.col("doc_id"))).write.partitionBy("part").json(resp)
    said = {r.doc_id: r.status.replace("READY", "PROCESSED") for r in response_status(parse_responses(spark.read.schema(stored_schema("string")).json(resp))).collect()}

    def answer(n, key, minute):
        with open(f"{st}/s{n}.json", "w") as f:
            f.write(json.dumps({"doc_id": ids[key], "status": said[ids[key]], "at": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00.000Z"}) + "\n")

    for n, (key, minute) in enumerate([("in/whole.pdf", 10), ("in/failed.pdf", 12), ("in/cut.pdf", 13), ("in/a b.pdf", 14)]):
        answer(n, key, minute)

    def run():
        E.start_manifest_stream(spark, ev, st, out, ckpt).awaitTermination()
        return sorted((r.raw_key, r.version, r.status, r.output_key) for r in E.read_manifest(spark, out).collect())

    first = run()
    assert "in/none.pdf" not in {k for k, *_ in first}, "decided before its time"
    # late, but within the delay; then both clocks move past the last event's hour
    events(2, record("in/late.pdf", 0), record("in/whole.pdf", 6, "v2"))
    answer(8, "in/late.pdf", 15)
    run()
    events(3, record("in/end.pdf", 600))
    with open(f"{st}/s9.json", "w") as f:
        f.write(json.dumps({"doc_id": "clock", "status": "PROCESSED", "at": "2024-01-01T10:00:00.000Z"}) + "\n")
    run()
    got = [r for r in run() if r[0] != "in/end.pdf"]
    assert len(got) == len(set(got)) == 8  # whole.pdf in two versions
    batch = run_batch(spark, spark.read.schema(EVENT).json(ev), resp, os.path.join(root, "res"))
    assert {(k, s, o) for k, _, s, o in got} == {(r.raw_key, r.status, r.output_key) for r in batch.where("raw_key <> 'in/end.pdf'").collect()}
    assert {s for _, _, s, _ in got} == {"PROCESSED", "OCR_ENGINE_ERROR", "CORRUPT_RESPONSE", "NO_RESPONSE", "KEY_ERROR"}
