"""Page text, key/value forms, tables and documents from block tables
(PRJ-1..5, JN-3..7, AGG-1..8, WIN-1, WIN-3, LIM-4, SET-1).

Profiles (how the three reference processors differ):

* ``current`` — pages are PAGE blocks; a page's lines are LINE blocks whose
  ``page`` equals the page number; ``block_count`` counts those lines;
  document forms/tables are recomputed over all blocks.
* ``sync`` — one analysis response per page: the page's blocks are those
  with that ``page``; ``block_count`` counts all of them; document
  forms/tables are the concatenation of the page lists (SET-1).
* ``legacy`` — like ``sync`` for pages, but a block's text is its own text,
  else the first CHILD relationship's existing children joined with ``''``;
  a key needs an existing value target of any type; an empty key is kept;
  tables without a CHILD relationship are dropped and non-CELL children are
  kept as cells.

Shuffles: the blocks are grouped by ``doc_id`` (bounded by the page limit of
admitted files) and read once; ids, lists and grids are then worked out for
batches of documents on Arrow columns (``operators/batches.py``).  Blocks dealt
by ``doc_id`` need no exchange, others one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import batches as B
from sheaf.operators.graph import scope_cols

PROFILES = ("current", "sync", "legacy")


# what a batch of documents needs of their blocks; relationships of the kinds that are asked for theirs
def _columns(*more: str, kinds: tuple[str, ...] = ()) -> list:
    rels = F.when(F.col("block_type").isin(*kinds), F.col("relationships")) if kinds else F.col("relationships")
    return ["block_ord", "block_type", "id", "text", "page", *more, rels.alias("relationships")]


def _rows(doc: np.ndarray, n: int, **columns) -> pa.Array:
    """A list of rows for each of ``n`` documents, by sorted ``doc``."""
    return B.lists(doc, n, pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def _page(s: B.Scope, group: np.ndarray) -> dict:
    """The page column of rows in page scope."""
    return {"page": s.page[group].astype(np.int32)} if hasattr(s, "keys") else {}


def _exploded(whole: DataFrame, scope: str, *names: str, out: str = "out") -> DataFrame:
    """The rows of the lists ``out``; ``whole``, a row a document, stays at hand
    for what is made of the same documents, which then need not be grouped again."""
    rows = whole.select("doc_id", F.explode(out).alias("r")).select(*[F.col(c if c == "doc_id" else f"r.{c}") for c in (*scope_cols(scope), *names)])
    rows.whole = whole
    return rows


# ---------------------------------------------------------------------------
# forms (AGG-5, PRJ-2, JN-5, JN-9)
# ---------------------------------------------------------------------------

def forms(blocks: DataFrame, scope: str = "document", profile: str = "current") -> DataFrame:
    """Key/value pairs: ``(doc_id, [page,] form_no, key, value)`` in the
    order a key id first appears; the last KEY block with an id wins.  Legacy
    pairing: every KEY block in block order; value = first block (any type)
    with the first VALUE id; pair only when it exists."""
    cols, legacy = scope_cols(scope), profile == "legacy"

    def made(b: pa.Array, known: pa.Array) -> pa.Array:
        s = B.Blocks(b, known).scope(scope)
        group, key, value = B.legacy_forms(s) if legacy else B.forms(s)
        return _rows(s.doc[group], len(b), **_page(s, group), form_no=B.place(group) + 1, key=key, value=value)

    page = "page:int," if len(cols) > 1 else ""
    out = B.per_document(blocks, _columns("entity_types", kinds=() if legacy else ("KEY_VALUE_SET",)), made,
                         f"array<struct<{page}form_no:bigint,key:string,value:string>>")
    return _exploded(out, scope, "form_no", "key", "value")


# ---------------------------------------------------------------------------
# tables (AGG-6, AGG-7, JN-6)
# ---------------------------------------------------------------------------

def table_cells(blocks: DataFrame, scope: str = "document", profile: str = "current") -> DataFrame:
    """Cells of every table in child order:
    ``(doc_id, [page,] table_no, cell_no, text, row_index, column_index)``.
    Missing row/column index is 0.  Legacy: tables without a CHILD relationship
    are dropped and any block is a cell (linear find: the first with the id)."""
    cols, legacy = scope_cols(scope), profile == "legacy"

    def made(b: pa.Array, known: pa.Array) -> pa.Array:
        s = B.Blocks(b, known).scope(scope)
        c = B.Cells(s, legacy)
        group = c.group[c.table]
        return _rows(s.doc[group], len(b), **_page(s, group), table_no=c.number[c.table] + 1, cell_no=c.at + 1, text=c.text, row_index=c.row, column_index=c.col)

    page = "page:int," if len(cols) > 1 else ""
    out = B.per_document(blocks, _columns("row_index", "column_index", kinds=() if legacy else ("TABLE", "CELL")), made,
                         f"array<struct<{page}table_no:bigint,cell_no:bigint,text:string,row_index:int,column_index:int>>", name="cells")
    return _exploded(out, scope, "table_no", "cell_no", "text", "row_index", "column_index", out="cells")


def table_grid(cells: DataFrame, scope: str = "document") -> DataFrame:
    """AGG-7: dense 1-based grid ``max(row) x max(column)`` filled with
    ``''``; a later cell overwrites an earlier one; index <= 0 is ignored;
    no grid when either extent is <= 0.
    ``(doc_id, [page,] table_no, row_no, col_no, text)``."""
    cols = scope_cols(scope)

    def made(b: pa.Array, *_: pa.Array) -> pa.Array:
        doc, c = B.parents(b), B.structs(b)
        key = [doc, *[B.numbers(c[k]) for k in (*cols[1:], "table_no")]]
        table, one = B.number(*key)
        order = np.lexsort((B.numbers(c["cell_no"]), table))
        # a missing index is as one that is ignored
        row, col = (B.numbers(c[k].fill_null(0))[order] for k in ("row_index", "column_index"))
        n_rows, n_cols, text = B.grid(table[order], len(one), row, col, c["text"].take(pa.array(order)))
        of = np.repeat(np.arange(len(one)), n_rows * n_cols)
        at = B.place(of)
        same = {k: c[k].take(pa.array(one[of])) for k in (*cols[1:], "table_no")}
        return _rows(doc[one[of]], len(b), **same, row_no=at // n_cols[of] + 1, col_no=at % n_cols[of] + 1, text=text)

    page = "page:int," if len(cols) > 1 else ""
    returns = f"array<struct<{page}table_no:bigint,row_no:bigint,col_no:bigint,text:string>>"
    if hasattr(cells, "whole"):
        out = B.listed(cells.whole, made, returns, "cells", name="grid")
    else:
        long = [F.col(c).cast("long").alias(c) for c in ("table_no", "cell_no")]
        out = B.per_document(cells, [*cols[1:], *long, "row_index", "column_index", "text"], made, returns, name="grid")
    grid = _exploded(out, scope, "table_no", "row_no", "col_no", "text", out="grid")
    grid.made_of = cells
    return grid


def table_rows(grid: DataFrame, scope: str = "document") -> DataFrame:
    """Grid as ``rows: array<array<string>>`` per table (bounded by the
    table's own size)."""
    key = [*scope_cols(scope), "table_no"]
    return (grid.groupBy(*key, "row_no")
            .agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("r"))
            .groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct(
                "row_no", F.transform("r", lambda x: x["text"]).alias("cells")))).alias("rr"))
            .select(*key, F.transform("rr", lambda x: x["cells"]).alias("rows")))


# ---------------------------------------------------------------------------
# pages (AGG-1..3, WIN-1, PRJ-3, JN-7)
# ---------------------------------------------------------------------------

def page_list(blocks: DataFrame, profile: str = "current") -> DataFrame:
    """WIN-1/PRJ-3: ``(doc_id, page_number, page)``.  ``current``: PAGE blocks
    numbered 1..n in block order; the page they select is ``Page`` or the
    position when ``Page`` is missing or 0.  ``sync``/``legacy``: one page per
    distinct page value (one response per page image)."""
    if profile == "current":
        w = Window.partitionBy("doc_id").orderBy("block_ord")
        return (blocks.filter(F.col("block_type") == "PAGE")
                .select("doc_id", "block_ord", "page")
                .withColumn("page_number", F.row_number().over(w).cast("long"))
                .select("doc_id", "page_number",
                        F.when(F.col("page").isNotNull() & (F.col("page") != 0), F.col("page"))
                        .otherwise(F.col("page_number")).cast("int").alias("page")))
    w = Window.partitionBy("doc_id").orderBy("page")
    return (blocks.filter(F.col("page").isNotNull()).select("doc_id", "page").distinct()
            .withColumn("page_number", F.row_number().over(w).cast("long"))
            .select("doc_id", "page_number", "page"))


def pages(blocks: DataFrame, profile: str = "current") -> DataFrame:
    """Flat page results: ``(doc_id, page_number, page, text, confidence,
    block_count, n_forms, n_tables)`` (LIM-4 counts included).  AGG-1..3: LINE
    texts in block order joined by newline (missing text is ''), mean LINE
    confidence (0 when none), block count (LINEs, or all blocks of the page for
    sync/legacy)."""
    legacy = profile == "legacy"

    def made(b: pa.Array, known: pa.Array) -> pa.Array:
        s = B.Blocks(b, known).scope("page")
        p = B.Pages(s, profile)
        text, confidence, count = p.lines(profile)
        pairs = (B.legacy_forms if legacy else B.forms)(s)[0]
        tables = np.flatnonzero(B.equals(s.b.kind, "TABLE") & s.usable)
        if legacy:
            tables = tables[s.b.first_ids(tables, "CHILD").is_valid().to_numpy(zero_copy_only=False)]
        n_forms, n_tables = (p.of(np.bincount(x, minlength=s.n), 0) for x in (pairs, s.group[tables]))
        return _rows(p.doc, len(b), page_number=p.number, page=p.page.astype(np.int32), text=text, confidence=confidence, block_count=count, n_forms=n_forms, n_tables=n_tables)

    kinds = () if legacy else ("KEY_VALUE_SET",)
    out = B.per_document(blocks, _columns("confidence", "entity_types", kinds=kinds), made, "array<struct<page_number:bigint,page:int,text:string,"
                         "confidence:double,block_count:bigint,n_forms:bigint,n_tables:bigint>>")
    return _exploded(out, "document", "page_number", "page", "text", "confidence", "block_count", "n_forms", "n_tables")


# ---------------------------------------------------------------------------
# document assembly (AGG-8, PRJ-4, PRJ-5)
# ---------------------------------------------------------------------------

# the defaults of engine, version and region below are FIXED VALUES of the envelope
def assemble(blocks: DataFrame, files: DataFrame | None = None, profile: str = "current",
             engine: str = "textract-analyze", run_ts: str = "1970-01-01T00:00:00.000Z",
             version: str = "1.0.0", region: str = "us-east-1",
             documents: DataFrame | None = None) -> DataFrame:
    """AGG-8: one nested result per document: per ``doc_id`` of ``documents``
    where given (a response without blocks has a result too), else per
    ``doc_id`` that has blocks.

    ``files`` (optional): ``(doc_id, input_file, file_size, processing_ms)``.
    The group per document is bounded: admitted files have at most the page
    limit of pages (TRI-4) and the size limit of bytes (TRI-1).
    """
    from sheaf.operators.nested import nested
    return _envelope(nested(blocks, documents, profile), files, engine, run_ts, version, region)


def _envelope(doc: DataFrame, files: DataFrame | None, engine: str, run_ts: str, version: str,
              region: str) -> DataFrame:
    if files is not None:
        doc = doc.join(files, "doc_id", "left")
    else:
        doc = (doc.withColumn("input_file", F.col("doc_id").cast("string"))
               .withColumn("file_size", F.lit(0).cast("long"))
               .withColumn("processing_ms", F.lit(0).cast("long")))
    # PRJ-5: envelope; run time is a parameter so results are repeatable
    return doc.select(
        "doc_id",
        F.lit(engine).alias("engine"),
        F.col("input_file").alias("inputFile"),
        F.coalesce("file_size", F.lit(0)).cast("long").alias("fileSize"),
        F.size("pages").alias("pageCount"),
        F.coalesce("processing_ms", F.lit(0)).cast("long").alias("processingTimeMs"),
        "pages", "forms", "tables",
        F.struct(F.lit(run_ts).alias("timestamp"), F.lit(version).alias("version"),
                 F.lit(region).alias("region")).alias("metadata"))
