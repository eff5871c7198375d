"""Nested documents (AGG-8) for batches of documents.

The blocks of a document are read once; forms and tables of both scopes, page
lines and the page list come from the same Arrow columns and are put together
as nested arrays by their offsets.  A document's lists are bounded by the page
limit of admitted files (TRI-4).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import batches as B
from sheaf.operators.assemble import _columns

FORM = "struct<key:string,value:string>"
TABLE = "struct<cells:array<struct<text:string,rowIndex:int,columnIndex:int>>,rows:array<array<string>>>"
PAGE = "pageNumber:bigint,text:string,confidence:double,blockCount:bigint"


def _struct(**columns) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _forms(s: B.Scope) -> tuple[np.ndarray, pa.Array]:
    group, key, value = B.forms(s, placed=True)
    return group, _struct(key=key, value=value)


def _tables(s: B.Scope) -> tuple[np.ndarray, pa.Array]:
    """Group and value of each table."""
    c = B.Cells(s, placed=True)
    n = len(c.group)
    rows, cols, slots = c.grid()
    lines = np.repeat(cols, rows)
    row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lines)]).astype(np.int32)), slots)
    cells = B.lists(c.table, n, _struct(text=c.text, rowIndex=c.row, columnIndex=c.col))
    return c.group, _struct(cells=cells, rows=B.lists(np.repeat(np.arange(n), rows), n, row))


def _of_pages(found: tuple[np.ndarray, pa.Array], p: B.Pages) -> tuple[np.ndarray, pa.Array]:
    """The values of each page of the list, one page after another."""
    group, values = found
    rows, of = B.gathered(values, group, p.s.n, p.group)
    return of, values.take(pa.array(rows))


def _nested(profile: str, b: pa.Array, known: pa.Array) -> pa.Array:
    blocks = B.Blocks(b, known)
    s, n = blocks.scope("page"), len(b)
    p = B.Pages(s, profile)
    keep = np.flatnonzero(blocks.known[p.doc]) if n else np.arange(0)
    text, confidence, count = p.lines(profile)
    page = {"pageNumber": p.number, "text": text, "confidence": confidence, "blockCount": count}
    lists = {}
    if profile != "legacy":
        document = blocks.scope("document")
        for name, made in (("forms", _forms), ("tables", _tables)):
            of, values = _of_pages(made(s), p)
            # PRJ-4: empty lists are left out (NULL fields vanish in JSON)
            page[name] = B.lists(of, len(p.doc), values, np.bincount(of, minlength=len(p.doc)) == 0)
            # SET-1: document lists of sync are the page lists in page order
            lists[name] = B.lists(p.doc[of], n, values) if profile == "sync" else B.lists(*_ordered(made(document), n))
    pages = _struct(**page).take(pa.array(keep))
    return _struct(pages=B.lists(p.doc[keep], n, pages), **lists)


def _ordered(found: tuple[np.ndarray, pa.Array], n: int) -> tuple[np.ndarray, int, pa.Array]:
    return found[0], n, found[1]


def nested(blocks: DataFrame, documents: DataFrame | None, profile: str) -> DataFrame:
    """``(doc_id, pages, forms, tables)`` for each ``doc_id`` of ``documents``,
    else of the blocks."""
    lists = "" if profile == "legacy" else f"forms:array<{FORM}>,tables:array<{TABLE}>"
    page = ",".join(filter(None, [PAGE, lists]))
    returns = ",".join(filter(None, [f"pages:array<struct<{page}>>", lists]))

    def made(b: pa.Array, known: pa.Array) -> pa.Array:
        return _nested(profile, b, known)

    columns = ["block_ord", "block_type", "text", "page", "confidence"] if profile == "legacy" else _columns(
        "confidence", "row_index", "column_index", "entity_types", kinds=("KEY_VALUE_SET", "CELL", "TABLE"))
    doc = B.per_document(blocks, columns, made, f"struct<{returns}>", documents).select("doc_id", "out.*")
    # legacy computes page forms/tables but does not return them
    return doc.withColumn("forms", F.lit(None)).withColumn("tables", F.lit(None)) if profile == "legacy" else doc
