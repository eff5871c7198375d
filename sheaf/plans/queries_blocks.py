"""Registered block-assembly queries over the D3 block graphs derived from
orders and lineitem.  The oracle SQL never builds a block graph: it reaches
the expected page text, forms and tables straight from the base tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheaf.functions.numbers import round6
from sheaf.operators import assemble as A
from sheaf.plans.registry import register
from sheaf.session import scratch_path
from sheaf.sinks import store
from sheaf.sources.blocks import blocks_from_responses, distinct_chunks, parse_responses
from sheaf.sources.blocks import response_status as response_states
from sheaf.sources.derived import order_blocks, order_responses
from sheaf.sources.tables import table


#: Orders and line items a partition of the derived blocks holds at most, on average.
ROWS_PER_PARTITION = 60_000


def blocks_of(spark, sf_dir):
    """Derived block table, dealt by document into partitions whose size does
    not grow with the tables.  It is not written: the operators read the kinds
    they need, in the partitions of their documents."""
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = orders.count() + lineitem.count()  # from the footers of the files
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))
    return order_blocks(orders, lineitem, parts)


# base-table route to the same answers
BASE = """
WITH li AS (
  SELECT l_orderkey AS doc_id, l_partkey, l_quantity, l_returnflag, l_linestatus, l_linenumber,
         l_discount,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
             l_shipdate) AS n,
         CAST(floor((l_linenumber - 1) / 4) + 1 AS INTEGER) AS page
  FROM lineitem),
li2 AS (SELECT *, l_linenumber - 4 * (page - 1) AS row_index FROM li),
docs AS (
  SELECT o.o_orderkey AS doc_id, o.o_orderstatus, o.o_orderpriority,
         CAST(coalesce(m.npages, 1) AS INTEGER) AS npages
  FROM orders o LEFT JOIN (SELECT doc_id, max(page) AS npages FROM li GROUP BY doc_id) m
    ON o.o_orderkey = m.doc_id),
pg AS (SELECT doc_id, unnest(range(1, npages + 1 + CAST(doc_id % 5 = 0 AS INTEGER))) AS page FROM docs),
tbl AS (
  SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS table_no
  FROM (SELECT DISTINCT doc_id, page FROM li)),
cells AS (
  SELECT li2.doc_id, tbl.table_no, li2.page, li2.n, li2.row_index, c.col AS column_index,
         CASE c.col WHEN 1 THEN CAST(l_partkey AS VARCHAR)
                    WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                    ELSE l_returnflag END AS text,
         (row_number() OVER (PARTITION BY li2.doc_id, li2.page ORDER BY li2.n, c.col)) AS cell_no
  FROM li2 JOIN tbl ON li2.doc_id = tbl.doc_id AND li2.page = tbl.page
  CROSS JOIN (SELECT unnest([1, 2, 3]) AS col) c),
forms_page AS (
  SELECT d.doc_id, f.form_no, f.key,
         CASE f.form_no WHEN 1 THEN d.o_orderstatus
                        WHEN 2 THEN CASE WHEN d.npages = 1 THEN d.o_orderpriority ELSE '' END
                        ELSE '' END AS value
  FROM docs d CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS form_no,
                                 unnest(['Order status', 'Order priority', 'Clerk', ' ']) AS key) f),
forms_doc AS (
  SELECT d.doc_id, f.form_no, f.key,
         CASE f.form_no WHEN 1 THEN d.o_orderstatus WHEN 2 THEN d.o_orderpriority ELSE '' END AS value
  FROM docs d CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS form_no,
                                 unnest(['Order status', 'Order priority', 'Clerk', ' ']) AS key) f),
page_text AS (
  SELECT p.doc_id, CAST(p.page AS BIGINT) AS page_number,
         coalesce(string_agg('P' || CAST(li.l_partkey AS VARCHAR) || ' ' || li.l_returnflag
                             || li.l_linestatus, chr(10) ORDER BY li.n), '') AS text,
         floor(coalesce(avg(CASE WHEN li.l_partkey % 7 <> 0 THEN li.l_quantity + 50 END), 0)
               * 1000000 + 0.5 + 1e-06) / 1000000 AS confidence,
         count(li.n) AS block_count,
         CAST(CASE WHEN p.page = 1 THEN 4 ELSE 0 END AS BIGINT) AS n_forms,
         CAST(CASE WHEN count(li.n) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_tables
  FROM pg p LEFT JOIN li ON li.doc_id = p.doc_id AND li.page = p.page
  GROUP BY p.doc_id, p.page),
dims AS (SELECT doc_id, table_no, max(row_index) AS max_row FROM cells GROUP BY ALL),
slots AS (SELECT doc_id, table_no, unnest(range(1, max_row + 1)) AS row_no FROM dims),
last AS (SELECT doc_id, table_no, row_index, column_index, arg_max(text, n) AS text
         FROM cells GROUP BY ALL),
grid AS (
  SELECT s.doc_id, CAST(s.table_no AS BIGINT) AS table_no, CAST(s.row_no AS BIGINT) AS row_no,
         CAST(c.col AS BIGINT) AS col_no, coalesce(l.text, '') AS text
  FROM slots s CROSS JOIN (SELECT unnest([1, 2, 3]) AS col) c
  LEFT JOIN last l ON l.doc_id = s.doc_id AND l.table_no = s.table_no AND l.row_index = s.row_no
    AND l.column_index = c.col),
words AS (
  SELECT doc_id, page, page * 1000000 + 200000 + n * 100 + col AS ord,
         CASE col WHEN 1 THEN CAST(l_partkey AS VARCHAR)
                  WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
                  ELSE l_returnflag END AS text,
         round(l_discount * 1000 + col - 1, 3) AS conf
  FROM li CROSS JOIN (SELECT unnest([1, 2, 3]) AS col) c
  UNION ALL
  SELECT d.doc_id, 1, 1500000 + k * 100, CASE WHEN k = 4 THEN d.o_orderstatus ELSE w END, cf
  FROM docs d CROSS JOIN (SELECT unnest([1, 2, 4, 6, 7, 9]) AS k,
                                 unnest(['Order', 'status', '', 'Order', 'priority', 'Clerk']) AS w,
                                 unnest([99.0, 98.0, 97.0, 0.0, 96.0, 95.0]) AS cf) kw
  UNION ALL
  SELECT doc_id, npages, npages * 1000000 + 600100, o_orderpriority, 94.0 FROM docs),
ocr AS (
  SELECT doc_id, CAST(page AS BIGINT) AS page_number,
         trim(string_agg(text, ' ' ORDER BY ord)) AS text,
         coalesce(avg(conf) FILTER (WHERE conf <> 0), 0) / 100 AS confidence,
         count(*) FILTER (WHERE conf <> 0) AS word_count
  FROM words WHERE length(text) > 0 GROUP BY doc_id, page),
shapes AS (
  SELECT doc_id, CAST(page AS BIGINT) AS page_number, (doc_id + page) % 3 <> 0 AS enabled,
         CAST((doc_id * 7 + page) % 5 AS INTEGER) AS shape_count,
         CASE (doc_id + page) % 4 WHEN 0 THEN 'circle' WHEN 1 THEN 'rectangle'
              WHEN 2 THEN 'unknown' END AS dominant_shape
  FROM pg),
totals AS (
  SELECT doc_id, count(*) AS pages, sum(length(text)) AS text_chars, sum(n_tables) AS tables,
         sum(n_forms) AS forms
  FROM page_text GROUP BY ROLLUP (doc_id))
"""


@register("response_status", "SRC-4/5, STR-1: READY only for documents whose responses are all there and sound", """
WITH n AS (SELECT o_orderkey AS doc_id, CAST(floor((coalesce(max(l_linenumber), 1) - 1) / 4) + 1 AS BIGINT) AS n
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
s AS (SELECT doc_id, doc_id % 17 AS k, CASE doc_id % 17 WHEN 9 THEN n - 1 ELSE n END AS n_chunks,
             CASE WHEN doc_id % 17 = 9 THEN n - 1 WHEN doc_id % 17 IN (10, 11) THEN n + 1 ELSE n END AS n_rows FROM n)
SELECT doc_id,
       CASE WHEN k = 1 THEN 'OCR_ENGINE_ERROR' WHEN k IN (3, 6, 7, 8, 11) THEN 'CORRUPT_RESPONSE'
            WHEN k IN (2, 4, 9) THEN 'INCOMPLETE' ELSE 'READY' END AS status,
       CASE WHEN k = 1 THEN 'job ' || CAST(doc_id AS VARCHAR) || ' failed' END AS status_message,
       n_chunks, n_rows
FROM s WHERE n_chunks > 0""")
def response_status(spark, sf_dir):
    rows = order_responses(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    return response_states(parse_responses(rows))


@register("response_blocks", "SRC-4/5: blocks of READY documents in chunk order; an empty block list is a document of 0 blocks", """
WITH n AS (SELECT o_orderkey AS doc_id, CAST(floor((coalesce(max(l_linenumber), 1) - 1) / 4) + 1 AS BIGINT) AS n
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT doc_id, CAST(CASE WHEN doc_id % 17 = 5 THEN 0 ELSE n END AS BIGINT) AS n_blocks,
       coalesce((SELECT string_agg('L' || CAST(x AS VARCHAR), ' ' ORDER BY x) FROM (SELECT unnest(range(0, n)) AS x) WHERE doc_id % 17 <> 5), '') AS ids
FROM n WHERE doc_id % 17 NOT IN (1, 2, 3, 4, 6, 7, 8, 9, 11)""")
def response_blocks(spark, sf_dir):
    chunks = parse_responses(order_responses(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")))
    states = response_states(chunks)
    ready = states.filter("status = 'READY'").select("doc_id")
    got = (blocks_from_responses(distinct_chunks(chunks, states)).groupBy("doc_id")
           .agg(F.array_sort(F.collect_list(F.struct("block_ord", "id"))).alias("b")))
    return (ready.join(got, "doc_id", "left")
            .select("doc_id", F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_blocks"),
                    F.coalesce(F.array_join(F.transform("b", lambda x: x["id"]), " "), F.lit("")).alias("ids")))


@register("results_latest", "SNK-1: versioned results after three epochs, a compaction and a run that never committed", """
SELECT o_orderkey AS doc_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS run,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS customer
FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0""")
def results_latest(spark, sf_dir):
    """Every order's document, then every third one's next version, then every
    fifth one's without a status and the end of every seventh."""
    key = F.col("doc_id")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("first").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    store.append(docs, path)
    store.append(docs.where(key % 3 == 0).withColumn("run", F.lit("second")).withColumn("customer", F.col("customer") + 1), path)
    store.compact(spark, path)
    store.write_run(docs.where(key % 2 == 0).withColumn("run", F.lit("lost")), path, 3)
    fifth = docs.where(key % 5 == 0).withColumn("run", F.lit("again")).withColumn("status", F.lit(None).cast("string"))
    ended = docs.where((key % 7 == 0) & (key % 5 != 0)).select("doc_id", F.lit(True).alias("_deleted"))
    store.append(fifth.withColumn("_deleted", F.lit(False)).unionByName(ended, allowMissingColumns=True), path)
    return store.latest(spark, path)


@register("page_text", "AGG-1..3, WIN-1, PRJ-3, JN-7, LIM-4 (current profile)",
          BASE + "SELECT * FROM page_text")
def page_text(spark, sf_dir):
    return (A.pages(blocks_of(spark, sf_dir))
            .select("doc_id", "page_number", "text", round6("confidence").alias("confidence"),
                    "block_count", "n_forms", "n_tables"))


@register("page_forms", "AGG-5, JN-3..5, PRJ-2 page scope (ids resolve on their page only)",
          BASE + """SELECT doc_id, CAST(1 AS BIGINT) AS page_number, CAST(form_no AS BIGINT) AS form_no,
                     key, value FROM forms_page""")
def page_forms(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return (A.forms(b, "page")
            .join(A.page_list(b), ["doc_id", "page"])
            .select("doc_id", "page_number", "form_no", "key", "value"))


@register("doc_forms", "AGG-5, JN-2..5 document scope",
          BASE + "SELECT doc_id, CAST(form_no AS BIGINT) AS form_no, key, value FROM forms_doc")
def doc_forms(spark, sf_dir):
    return A.forms(blocks_of(spark, sf_dir), "document")


@register("doc_table_cells", "AGG-6, JN-6 (cells in child order, index default 0)",
          BASE + """SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, CAST(cell_no AS BIGINT) AS cell_no,
                     text, CAST(row_index AS INTEGER) AS row_index,
                     CAST(column_index AS INTEGER) AS column_index FROM cells""")
def doc_table_cells(spark, sf_dir):
    return A.table_cells(blocks_of(spark, sf_dir), "document")


@register("doc_table_grid", "AGG-7, WIN-3 (dense grid, later cell wins)",
          BASE + "SELECT * FROM grid")
def doc_table_grid(spark, sf_dir):
    return A.table_grid(A.table_cells(blocks_of(spark, sf_dir), "document"), "document")


# the whole content of nested documents as flat text, in list order
CONTENT = """,
ct AS (SELECT doc_id, table_no, page, count(*) AS n_cells,
              string_agg(text || '@' || CAST(row_index AS VARCHAR) || ',' || CAST(column_index AS VARCHAR), ';' ORDER BY cell_no) AS c
       FROM cells GROUP BY doc_id, table_no, page),
gr AS (SELECT doc_id, table_no, row_no, string_agg(text, '|' ORDER BY col_no) AS r FROM grid GROUP BY doc_id, table_no, row_no),
gt AS (SELECT doc_id, table_no, string_agg(r, '/' ORDER BY row_no) AS g FROM gr GROUP BY doc_id, table_no),
one_table AS (SELECT ct.doc_id, ct.table_no, ct.page, ct.n_cells, ct.c || '#' || gt.g AS t
              FROM ct JOIN gt ON gt.doc_id = ct.doc_id AND gt.table_no = ct.table_no),
all_tables AS (SELECT doc_id, count(*) AS n_tables, sum(n_cells) AS n_cells, string_agg(t, chr(10) ORDER BY table_no) AS tables
               FROM one_table GROUP BY doc_id),
page_form_list AS (SELECT doc_id, string_agg(key || '=' || value, chr(10) ORDER BY form_no) AS f FROM forms_page GROUP BY doc_id),
doc_form_list AS (SELECT doc_id, string_agg(key || '=' || value, chr(10) ORDER BY form_no) AS f FROM forms_doc GROUP BY doc_id),
page_rows AS (
  SELECT p.doc_id, p.page_number, p.text, p.block_count, d.npages,
         CASE WHEN p.page_number = 1 THEN f.f ELSE 'none' END AS forms, coalesce(t.t, 'none') AS tables
  FROM page_text p JOIN docs d ON d.doc_id = p.doc_id JOIN page_form_list f ON f.doc_id = p.doc_id
  LEFT JOIN one_table t ON t.doc_id = p.doc_id AND t.page = p.page_number)
"""
ENVELOPE = """'textract-analyze' AS engine, CAST(d.doc_id AS VARCHAR) AS input_file, CAST(0 AS BIGINT) AS file_size,
       CAST(0 AS BIGINT) AS processing_ms, '1970-01-01T00:00:00.000Z 1.0.0 us-east-1' AS run"""


def content_sql(blocks: str, forms: str) -> str:
    return BASE + CONTENT + f""", pp AS (
  SELECT doc_id, count(*) AS page_count,
         string_agg(CAST(page_number AS VARCHAR) || '~' || text || '~' || CAST({blocks} AS VARCHAR) || '~' || forms || '~' || tables,
                    chr(10) || chr(10) ORDER BY page_number) AS pages
  FROM page_rows GROUP BY doc_id)
SELECT d.doc_id, {ENVELOPE}, CAST(pp.page_count AS INTEGER) AS page_count, CAST(coalesce(t.n_tables, 0) AS INTEGER) AS n_tables,
       CAST(coalesce(t.n_cells, 0) AS BIGINT) AS n_cells, pp.pages, f.f AS forms, coalesce(t.tables, '') AS tables
FROM docs d JOIN pp ON pp.doc_id = d.doc_id JOIN {forms} f ON f.doc_id = d.doc_id LEFT JOIN all_tables t ON t.doc_id = d.doc_id"""


def _form_text(forms):
    return F.array_join(F.transform(forms, lambda f: F.concat(f["key"], F.lit("="), f["value"])), "\n")


def _table_text(tables):
    cell = lambda c: F.concat(c["text"], F.lit("@"), c["rowIndex"].cast("string"), F.lit(","), c["columnIndex"].cast("string"))
    one = lambda t: F.concat(F.array_join(F.transform(t["cells"], cell), ";"), F.lit("#"),
                             F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, "|")), "/"))
    return F.array_join(F.transform(tables, one), "\n")


def flat_content(docs):
    """Envelope, pages, forms and tables of nested documents as text columns;
    an absent page list (PRJ-4) reads ``none``."""
    page = lambda p: F.concat_ws("~", p["pageNumber"].cast("string"), p["text"], p["blockCount"].cast("string"),
                                 F.coalesce(_form_text(p["forms"]), F.lit("none")), F.coalesce(_table_text(p["tables"]), F.lit("none")))
    return docs.select(
        "doc_id", "engine", F.col("inputFile").alias("input_file"), F.col("fileSize").alias("file_size"),
        F.col("processingTimeMs").alias("processing_ms"),
        F.concat_ws(" ", "metadata.timestamp", "metadata.version", "metadata.region").alias("run"),
        F.col("pageCount").alias("page_count"), F.size("tables").alias("n_tables"),
        F.aggregate("tables", F.lit(0).cast("long"), lambda acc, t: acc + F.size(t["cells"])).alias("n_cells"),
        F.array_join(F.transform("pages", page), "\n\n").alias("pages"),
        _form_text(F.col("forms")).alias("forms"), _table_text(F.col("tables")).alias("tables"))


@register("doc_assembly", "AGG-8, PRJ-4/5 nested documents: envelope and whole content", content_sql("block_count", "doc_form_list"))
def doc_assembly(spark, sf_dir):
    return flat_content(A.assemble(blocks_of(spark, sf_dir)))


@register("page_text_sync", "sync profile: one response per page, block_count = all blocks",
          BASE + """SELECT p.doc_id, p.page_number, p.text, p.confidence,
       CAST(1 + 7 * p.block_count + CASE WHEN p.block_count > 0 THEN 1 ELSE 0 END
            + CASE WHEN p.page_number = 1 THEN 12 ELSE 0 END
            + CASE WHEN p.page_number = d.npages THEN 2 ELSE 0 END AS BIGINT) AS block_count,
       p.n_forms, p.n_tables
FROM page_text p JOIN docs d ON d.doc_id = p.doc_id""")
def page_text_sync(spark, sf_dir):
    return (A.pages(blocks_of(spark, sf_dir), "sync")
            .select("doc_id", "page_number", "text", round6("confidence").alias("confidence"),
                    "block_count", "n_forms", "n_tables"))


@register("doc_forms_legacy", "JN-9 legacy pairing and text rule (own text, else children joined by '')",
          BASE + """SELECT doc_id, CAST(1 AS BIGINT) AS form_no, 'Orderstatus' AS key, o_orderstatus AS value
FROM docs UNION ALL
SELECT doc_id, CAST(2 AS BIGINT), 'Orderpriority', o_orderpriority FROM docs""")
def doc_forms_legacy(spark, sf_dir):
    return A.forms(blocks_of(spark, sf_dir), "document", "legacy")


@register("page_forms_legacy", "JN-9 legacy, page scope: a value on another page drops the pair",
          BASE + """SELECT doc_id, CAST(1 AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS form_no,
       'Orderstatus' AS key, o_orderstatus AS value FROM docs UNION ALL
SELECT doc_id, CAST(1 AS BIGINT), CAST(2 AS BIGINT), 'Orderpriority', o_orderpriority FROM docs
WHERE npages = 1""")
def page_forms_legacy(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return (A.forms(b, "page", "legacy").join(A.page_list(b, "legacy"), ["doc_id", "page"])
            .select("doc_id", "page_number", "form_no", "key", "value"))


@register("page_table_cells", "AGG-6, JN-4/JN-6 page scope (cells resolve on their page)",
          BASE + """SELECT doc_id, CAST(page AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS table_no,
       CAST(cell_no AS BIGINT) AS cell_no, text, CAST(row_index AS INTEGER) AS row_index,
       CAST(column_index AS INTEGER) AS column_index FROM cells""")
def page_table_cells(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return (A.table_cells(b, "page").join(A.page_list(b), ["doc_id", "page"])
            .select("doc_id", "page_number", "table_no", "cell_no", "text", "row_index",
                    "column_index"))


@register("page_table_grid", "AGG-7 page scope", BASE + """
SELECT g.doc_id, CAST(t.page AS BIGINT) AS page_number, CAST(1 AS BIGINT) AS table_no, g.row_no, g.col_no,
       g.text
FROM grid g JOIN tbl t ON t.doc_id = g.doc_id AND t.table_no = g.table_no""")
def page_table_grid(spark, sf_dir):
    b = blocks_of(spark, sf_dir)
    return (A.table_grid(A.table_cells(b, "page"), "page").join(A.page_list(b), ["doc_id", "page"])
            .select("doc_id", "page_number", "table_no", "row_no", "col_no", "text"))


@register("doc_table_cells_legacy", "JN-9 legacy tables: any child kept, own text else children",
          BASE + """SELECT doc_id, CAST(table_no AS BIGINT) AS table_no, CAST(cell_no AS BIGINT) AS cell_no,
                     text, CAST(row_index AS INTEGER) AS row_index,
                     CAST(column_index AS INTEGER) AS column_index FROM cells""")
def doc_table_cells_legacy(spark, sf_dir):
    return A.table_cells(blocks_of(spark, sf_dir), "document", "legacy")


@register("doc_forms_sync", "SET-1 sync: document forms = page forms concatenated in page order",
          BASE + """SELECT doc_id, CAST(form_no AS BIGINT) AS form_no, key, value FROM forms_page""")
def doc_forms_sync(spark, sf_dir):
    from pyspark.sql import Window
    b = blocks_of(spark, sf_dir)
    pf = A.forms(b, "page", "sync").join(A.page_list(b, "sync"), ["doc_id", "page"])
    w = Window.partitionBy("doc_id").orderBy("page_number", "form_no")
    return pf.select("doc_id", F.row_number().over(w).cast("long").alias("form_no"), "key", "value")


SYNC_BLOCKS = """(1 + 7 * block_count + CASE WHEN block_count > 0 THEN 1 ELSE 0 END
            + CASE WHEN page_number = 1 THEN 12 ELSE 0 END + CASE WHEN page_number = npages THEN 2 ELSE 0 END)"""


@register("doc_assembly_sync", "AGG-8 sync profile: document lists are page lists concatenated; whole content",
          content_sql(SYNC_BLOCKS, "page_form_list"))
def doc_assembly_sync(spark, sf_dir):
    return flat_content(A.assemble(blocks_of(spark, sf_dir), profile="sync"))


@register("doc_assembly_legacy", "AGG-8 legacy profile: pages only (page forms/tables not returned); whole content",
          BASE + f"""SELECT p.doc_id, CAST(count(*) AS INTEGER) AS page_count, false AS has_doc_lists,
       string_agg(CAST(page_number AS VARCHAR) || '~' || text || '~' || CAST({SYNC_BLOCKS} AS VARCHAR),
                  chr(10) || chr(10) ORDER BY page_number) AS pages
FROM page_text p JOIN docs d ON d.doc_id = p.doc_id GROUP BY p.doc_id""")
def doc_assembly_legacy(spark, sf_dir):
    docs = A.assemble(blocks_of(spark, sf_dir), profile="legacy")
    page = lambda p: F.concat_ws("~", p["pageNumber"].cast("string"), p["text"], p["blockCount"].cast("string"))
    return docs.select("doc_id", F.col("pageCount").alias("page_count"),
                       (F.col("forms").isNotNull() | F.col("tables").isNotNull()).alias("has_doc_lists"),
                       F.array_join(F.transform("pages", page), "\n\n").alias("pages"))
