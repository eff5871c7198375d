"""Block-graph goldens: the three profiles on the reference's own test
response, response JSON round trip, page scope vs document scope."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from sheaf.operators import assemble as A
from sheaf.sinks.results import read_results, render_json, write_results
from sheaf.sources import derived as DV
from sheaf.sources.blocks import blocks_from_responses, read_responses, to_responses, write_responses
from sheaf.sources.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, block_ord long, block_type string, id string, text string, "
          "confidence double, page int, row_index int, column_index int, "
          "entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>")


def _test_response(spark):
    rows = [
        (1, 0, "KEY_VALUE_SET", "1", None, None, 1, None, None, ["KEY"], [("VALUE", ["2"])]),
        (1, 1, "KEY_VALUE_SET", "2", "Sample Value", None, 1, None, None, ["VALUE"], None),
        (1, 2, "TABLE", "3", None, None, 1, None, None, None, [("CHILD", ["4"])]),
        (1, 3, "CELL", "4", "Cell Text", None, 1, 1, 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_profiles_on_reference_test_response(spark):
    b = _test_response(spark)
    for profile in ("current", "sync"):
        assert A.forms(b, "document", profile).count() == 0
        cells = A.table_cells(b, "document", profile).collect()
        assert [(c.text, c.row_index, c.column_index) for c in cells] == [("", 1, 1)]
        grid = A.table_grid(A.table_cells(b, "document", profile)).collect()
        assert [(g.row_no, g.col_no, g.text) for g in grid] == [(1, 1, "")]
    legacy_forms = A.forms(b, "document", "legacy").collect()
    assert [(f.key, f.value) for f in legacy_forms] == [("", "Sample Value")]
    legacy_cells = A.table_cells(b, "document", "legacy").collect()
    assert [c.text for c in legacy_cells] == ["Cell Text"]
    # no PAGE block: the current profile has no pages, sync has one
    assert A.assemble(b).first().pageCount == 0
    sync = A.assemble(b, profile="sync").first()
    assert sync.pageCount == 1 and sync.tables[0].rows == [[""]] and sync.forms == []


def test_page_scope_value_on_other_page_is_empty(spark):
    orders = table(spark, SF, "orders").filter("o_orderkey < 40")
    b = DV.order_blocks(orders, table(spark, SF, "lineitem").filter("l_orderkey < 40"))
    # pages with words (every fifth document ends with a blank one)
    npages = {r.doc_id: r.n for r in b.filter("block_type = 'WORD'").groupBy("doc_id").agg(F.max("page").alias("n")).collect()}
    page = {(r.doc_id, r.key): r.value for r in A.forms(b, "page").collect()}
    doc = {(r.doc_id, r.key): r.value for r in A.forms(b, "document").collect()}
    for (d, k), v in doc.items():
        assert (d, k) in page
        if k == "Order priority":
            assert page[(d, k)] == (v if npages[d] == 1 else "")
        if k == " ":
            assert v == ""   # two missing children: one space, kept


def test_response_round_trip(spark):
    orders = table(spark, SF, "orders").filter("o_orderkey < 30")
    b = DV.order_blocks(orders, table(spark, SF, "lineitem").filter("l_orderkey < 30"))
    path = os.path.join(tempfile.mkdtemp(prefix="sheaf-resp-"), "r")
    write_responses(to_responses(b), path)
    back = blocks_from_responses(read_responses(spark, path))
    def summary(x):
        return sorted((r.doc_id, r.pageCount, json.dumps(r.asDict(recursive=True)["pages"], sort_keys=True))
                      for r in A.assemble(x).collect())
    assert summary(back) == summary(b)


def test_render_json_drops_empty_lists(spark):
    b = _test_response(spark)
    j = json.loads(render_json(A.assemble(b, profile="sync")).first().json)
    assert "forms" not in j["pages"][0] and j["pages"][0]["tables"][0]["rows"] == [[""]]


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_page_number_falls_back_to_position(spark):
    # PAGE blocks: Page missing, Page 0, Page 7 -> numbers 1, 2, 3 select pages 1, 2, 7
    rows = [
        (5, 0, "PAGE", "p1", None, None, None, None, None, None, None),
        (5, 1, "PAGE", "p2", None, None, 0, None, None, None, None),
        (5, 2, "PAGE", "p3", None, None, 7, None, None, None, None),
        (5, 3, "LINE", "l1", "one", 80.0, 1, None, None, None, None),
        (5, 4, "LINE", "l2", "two", None, 2, None, None, None, None),
        (5, 5, "LINE", "l7", None, 60.0, 7, None, None, None, None),
        (5, 6, "LINE", "lx", "lost", 10.0, None, None, None, None, None),
    ]
    got = {r.page_number: (r.page, r.text, r.confidence, r.block_count)
           for r in A.pages(_rows(spark, rows)).collect()}
    assert got == {1: (1, "one", 80.0, 1), 2: (2, "two", 0.0, 1), 3: (7, "", 60.0, 1)}


def test_sync_document_lists_concatenate_pages(spark):
    def kv(doc, o, page, kid, vid, key, value):
        return [
            (doc, o, "KEY_VALUE_SET", kid, None, None, page, None, None, ["KEY"],
             [("CHILD", [kid + "w"]), ("VALUE", [vid])]),
            (doc, o + 1, "WORD", kid + "w", key, 90.0, page, None, None, None, None),
            (doc, o + 2, "KEY_VALUE_SET", vid, None, None, page, None, None, ["VALUE"],
             [("CHILD", [vid + "w"])]),
            (doc, o + 3, "WORD", vid + "w", value, 90.0, page, None, None, None, None),
        ]
    # the same ids on both pages: page lists differ from a document-wide map
    rows = kv(9, 10, 2, "k", "v", "B", "b2") + kv(9, 0, 1, "k", "v", "A", "a1")
    b = _rows(spark, rows)
    sync = A.assemble(b, profile="sync").first()
    assert [(f.key, f.value) for f in sync.forms] == [("A", "a1"), ("B", "b2")]
    cur = A.forms(b, "document").collect()
    # document scope: the later KEY block with id k wins, at the first position
    assert [(f.key, f.value) for f in cur] == [("B", "b2")]


def test_run_batch_event_to_results(spark):
    from sheaf.plans.batch import document_id, run_batch
    from sheaf.sources.events import EVENT
    orders = table(spark, SF, "orders").filter("o_orderkey < 12")
    b = DV.order_blocks(orders, table(spark, SF, "lineitem").filter("l_orderkey < 12"))
    keys = [f"in/{i}.pdf" for i in range(12)] + ["in/missing.pdf", "bad%zz.pdf"]
    ids = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "o long, key string")
    ids = ids.withColumn("new_id", document_id(F.lit("bkt"), F.col("key")))
    # stored responses keyed by the object's id
    remap = b.join(ids.withColumnRenamed("o", "doc_id"), "doc_id").drop("doc_id", "key") \
             .withColumnRenamed("new_id", "doc_id")
    root = tempfile.mkdtemp(prefix="sheaf-e1-")
    write_responses(to_responses(remap), os.path.join(root, "resp"))
    recs = [{"eventName": "ObjectCreated:Put",
             "s3": {"bucket": {"name": "bkt"}, "object": {"key": k, "size": 100 + i}}}
            for i, k in enumerate(keys)]
    ev = spark.read.schema(EVENT).json(spark.sparkContext.parallelize([json.dumps({"Records": recs})]))
    manifest = {r.raw_key: (r.status, r.output_key) for r in
                run_batch(spark, ev, os.path.join(root, "resp"), os.path.join(root, "out")).collect()}
    assert manifest["in/3.pdf"] == ("PROCESSED", "processed/in/3-result.json")
    assert manifest["in/missing.pdf"][0] == "NO_RESPONSE"
    assert manifest["bad%zz.pdf"] == ("KEY_ERROR", None)
    out = read_results(spark, os.path.join(root, "out"))
    row = out.filter(F.col("inputFile") == "in/3.pdf").first()
    assert row.fileSize == 103 and row.metadata.version == "1.0.0"
    assert out.count() == 12


def test_damaged_failed_and_empty_responses_are_never_processed(spark):
    from sheaf.plans.batch import document_id, run_batch
    from sheaf.sources.blocks import folder
    from sheaf.sources.events import EVENT
    block = '{"BlockType":"PAGE","Id":"p","Page":1}'
    good = '{"JobStatus":"SUCCEEDED","NextToken":"t","Blocks":[%s]}' % block
    last = '{"JobStatus":"SUCCEEDED","Blocks":[%s]}' % block
    chunks = {"whole": [good, last], "cut": [good, last[:30]], "corrupt": ["{oops"], "blank": [""], "null": [None], "empty": ['{"JobStatus":"SUCCEEDED","Blocks":[]}'],
              "failed": [good, '{"JobStatus":"FAILED","StatusMessage":"bad pdf"}'], "running": ['{"JobStatus":"IN_PROGRESS"}'], "nostatus": ['{"Blocks":[]}'],
              "waiting": [good], "twice": [last, last], "differing": [last, last + " "]}
    rows = [(k, 0 if k in ("twice", "differing") else n, body) for k, bodies in chunks.items() for n, body in enumerate(bodies)]
    stored = (spark.createDataFrame(rows, "key string, chunk_no int, body string")
              .withColumn("doc_id", document_id(F.lit("bkt"), F.concat(F.lit("in/"), F.col("key"), F.lit(".pdf")))).drop("key"))
    root = tempfile.mkdtemp(prefix="sheaf-bad-")
    stored.withColumn("part", folder(F.col("doc_id"))).write.partitionBy("part").json(os.path.join(root, "resp"))
    recs = [{"s3": {"bucket": {"name": "bkt"}, "object": {"key": f"in/{k}.pdf", "size": n}}} for n in (1, 2) for k in chunks]
    ev = spark.read.schema(EVENT).json(spark.sparkContext.parallelize([json.dumps({"Records": recs})]))
    got = {r.key[3:-4]: r.status for r in run_batch(spark, ev, os.path.join(root, "resp"), os.path.join(root, "out")).collect()}
    assert got == {"whole": "PROCESSED", "empty": "PROCESSED", "cut": "CORRUPT_RESPONSE", "corrupt": "CORRUPT_RESPONSE", "blank": "CORRUPT_RESPONSE", "null": "CORRUPT_RESPONSE",
                   "nostatus": "CORRUPT_RESPONSE", "failed": "OCR_ENGINE_ERROR", "running": "INCOMPLETE", "waiting": "INCOMPLETE", "twice": "PROCESSED", "differing": "CORRUPT_RESPONSE"}
    out = {r.inputFile: (r.pageCount, r.fileSize) for r in read_results(spark, os.path.join(root, "out")).collect()}
    assert out == {"in/whole.pdf": (2, 2), "in/empty.pdf": (0, 2), "in/twice.pdf": (1, 2)}  # the last record of a key gives the envelope


def test_results_are_replaced_document_by_document(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sheaf-res-"), "out")
    schema = "doc_id long, v string"
    write_results(spark.createDataFrame([(i, "a") for i in range(50)], schema), path, folders=4)
    write_results(spark.createDataFrame([(i, "b") for i in range(40, 60)], schema), path, folders=4)
    write_results(spark.createDataFrame([(i, "b") for i in range(40, 60)], schema), path, folders=4)
    assert sorted((r.doc_id, r.v) for r in read_results(spark, path, schema).collect()) == [(i, "a" if i < 40 else "b") for i in range(60)]


def test_legacy_document_without_page_numbers_has_a_result(spark):
    b = spark.createDataFrame([(1, 0, "LINE", "1", "x", None, None, None, None, None, None), (2, 0, "LINE", "1", "y", None, 1, None, None, None, None)], SCHEMA)
    assert {r.doc_id: r.pageCount for r in A.assemble(b, profile="legacy").collect()} == {1: 0, 2: 1}


def test_shared_folder_is_required_off_local():
    from types import SimpleNamespace

    import pytest

    from sheaf.session import checkpoint_dir, is_local
    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
    none = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="yarn")))
