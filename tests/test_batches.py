"""Blocks are read once by each operator, and batches of documents give what
single documents give."""

import numpy as np
import pyarrow as pa
import pytest

from sheaf.operators import assemble as A
from sheaf.operators import batches as B
from sheaf.operators import stats as S
from sheaf.plans import registry
from sheaf.plans.queries_blocks import blocks_of

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, block_ord long, block_type string, id string, text string, "
          "confidence double, page int, row_index int, column_index int, "
          "entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>")


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("name, reads", [
    ("doc_assembly", 1), ("table_preview", 1), ("doc_forms_legacy", 1), ("page_text_sync", 1), ("first_table_rows", 2), ("page_table_grid", 2)])
def test_blocks_are_read_once_by_an_operator(spark, name, reads):
    assert _scans(registry.queries()[name](spark, SF)) <= reads * _scans(blocks_of(spark, SF))


def _document(doc, word):
    """A form whose key was delivered twice, a table with a hole and a page."""
    return [
        (doc, 0, "PAGE", "p", None, None, 1, None, None, None, None),
        (doc, 1, "LINE", "l1", word, 50.0, 1, None, None, None, None),
        (doc, 2, "LINE", "l2", None, None, 1, None, None, None, None),
        *[(doc, 3, "KEY_VALUE_SET", "k", None, None, 1, None, None, ["KEY"], [("CHILD", ["w", "none"]), ("VALUE", ["v"])])] * 2,
        (doc, 4, "KEY_VALUE_SET", "v", None, None, 1, None, None, ["VALUE"], [("CHILD", ["w", "w"])]),
        (doc, 5, "WORD", "w", "early", 1.0, 1, None, None, None, None),
        (doc, 6, "WORD", "w", word, 1.0, 1, None, None, None, None),
        (doc, 7, "TABLE", "t", None, None, 1, None, None, None, [("CHILD", ["c1", "c2", "w", "c1"])]),
        (doc, 8, "CELL", "c1", None, None, 1, 2, 2, None, [("CHILD", ["w"])]),
        (doc, 9, "CELL", "c2", None, None, 1, None, 1, None, None),
    ]


def test_lookups_stay_inside_their_document(spark):
    rows = [r for d in range(40) for r in _document(d, f"é{d}")] + _document(None, "lost")
    b = spark.createDataFrame(rows, SCHEMA).repartition(3, "block_type")
    assert sorted((r.doc_id, r.key, r.value) for r in A.forms(b).collect()) == sorted((d, f"é{d} ", f"é{d} é{d}") for d in range(40))
    cells = A.table_cells(b, "page")
    want = [(d, 1, n, t, i, k) for d in range(40) for n, t, i, k in ((1, f"é{d}", 2, 2), (2, "", 0, 1), (4, f"é{d}", 2, 2))]
    assert sorted((r.doc_id, r.table_no, r.cell_no, r.text, r.row_index, r.column_index) for r in cells.collect()) == want
    grid = [(d, i, k, f"é{d}" if (i, k) == (2, 2) else "") for d in range(40) for i in (1, 2) for k in (1, 2)]
    flat = spark.createDataFrame(cells.collect(), cells.schema)  # cells from elsewhere are grouped
    for c in (cells, flat):
        assert sorted((r.doc_id, r.row_no, r.col_no, r.text) for r in A.table_grid(c, "page").collect()) == grid
    pages = {r.doc_id: (r.page_number, r.text, r.confidence, r.block_count, r.n_forms, r.n_tables) for r in A.pages(b).collect()}
    assert pages == {d: (1, f"é{d}\n", 50.0, 2, 1, 1) for d in range(40)} | {None: (1, "", 0.0, 0, 0, 0)}
    docs = {r.doc_id: r for r in A.assemble(b).collect()}
    assert len(docs) == 41 and docs[None].pages == [] and docs[None].forms == [] and docs[None].tables == []
    assert all([(f.key, f.value) for f in docs[d].pages[0].forms] == [(f"é{d} ", f"é{d} é{d}")] and docs[d].tables[0].rows == [["", ""], ["", f"é{d}"]] for d in range(40))
    # each copy of a key pairs with each copy
    legacy = [(r.doc_id, r.form_no, r.key, r.value) for r in A.forms(b, "document", "legacy").collect()]
    assert sorted(legacy) == [(d, n, "early" * 2, "early" * 2) for d in range(40) for n in (1, 2, 3, 4)]


def test_preview_of_a_grid_from_elsewhere_is_the_same(spark):
    b = spark.createDataFrame([r for d in range(5) for r in _document(d, f"w{d}")], SCHEMA)
    cells = A.table_cells(b)
    grid = A.table_grid(cells)
    flat = spark.createDataFrame(grid.collect(), grid.schema)
    want = sorted(S.table_preview(flat, cells=cells).collect())
    assert sorted(S.table_preview(grid, cells=cells).collect()) == want and len(want) == 10


def test_equal_places_are_told_apart_by_text():
    b = pa.array([[{"block_ord": 1, "block_type": "WORD", "id": "w", "text": t, "page": None} for t in ("b", None, "a")]])
    s = B.Blocks(b.cast(pa.list_(pa.struct([("block_ord", pa.int64()), ("block_type", pa.string()), ("id", pa.string()), ("text", pa.string()), ("page", pa.int32())]))), pa.array([True])).scope("document")
    asked = np.zeros(1, np.int64)
    assert s.lookup(asked, pa.array(["w"]), "text").tolist() == [0] and s.lookup(asked, pa.array(["w"]), "text", first=True).tolist() == [1]
    assert s.lookup(asked, pa.array(["x"]), "text").tolist() == [-1] and s.lookup(asked, pa.array([None], pa.string()), "text").tolist() == [-1]
