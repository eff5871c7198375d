"""Inputs derived from the driver tables.

The driver tables hold no OCR output, so the document-block and
drawing-text inputs are derived from them by plain Spark SQL expressions.
The same expression text (two small dialect switches) runs in DuckDB for
the oracle, so both sides see identical inputs; the work grows with the
base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NL = {"spark": "'\\n'", "duck": "chr(10)"}
GFLAG = {"spark": "", "duck": ", 'g'"}

# D2: one title-block text per part; p_partkey picks the line variants so
# that every routing rule occurs.  U+3000 is written as the literal char.
TITLE_BLOCK_TEXT = """
concat_ws({nl},
  CASE p_partkey % 8
    WHEN 0 THEN concat('Drawing No: KA', lpad(CAST(p_partkey AS STRING), 5, '0'), '-A', lpad(CAST(p_size AS STRING), 6, '0'))
    WHEN 1 THEN concat('Drawing Number: KA', lpad(CAST(p_partkey AS STRING), 5, '0'), '-A', lpad(CAST(p_size AS STRING), 6, '0'))
    WHEN 2 THEN concat('図面　No:　X-', CAST(p_partkey AS STRING))
    WHEN 3 THEN concat('図面番号：ka-', lpad(CAST(p_partkey % 100 AS STRING), 2, '0'), ' rev')
    WHEN 4 THEN concat('KA', lpad(CAST(p_partkey AS STRING), 5, '0'), '-A', lpad(CAST(p_size AS STRING), 4, '0'))
    WHEN 5 THEN concat('AB', CAST(10 + p_partkey % 90 AS STRING), '-C', CAST(10 + p_size AS STRING))
    WHEN 6 THEN concat(CAST(100 + p_partkey % 900 AS STRING), '-', CAST(100 + p_size * 7 AS STRING), ' ',
                       CAST(1000 + p_partkey % 9000 AS STRING), '-', CAST(1000 + p_size AS STRING), 'L')
    ELSE 'Drawing Notes'
  END,
  CASE p_partkey % 3 WHEN 0 THEN 'DWG' WHEN 1 THEN 'dravving' ELSE 'Part list' END,
  concat('AB', CAST(10 + p_size AS STRING), 'CD', CAST(p_partkey AS STRING)),
  CASE p_partkey % 5
    WHEN 0 THEN '4-M6'
    WHEN 1 THEN '4-M12'
    WHEN 2 THEN '10-M12'
    WHEN 3 THEN concat('φ', CAST(p_size AS STRING), '.5 x 30')
    ELSE concat(CAST(10000 + (p_partkey * 3) % 90000 AS STRING), '-', lpad(CAST(p_size AS STRING), 4, '0'))
  END,
  CASE WHEN p_partkey % 2 = 0 THEN concat('2024/01/', lpad(CAST(1 + p_size % 28 AS STRING), 2, '0'))
       ELSE concat('2023-', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '-15') END,
  CASE p_partkey % 3
    WHEN 0 THEN '材料: ステンレス'
    WHEN 1 THEN '　部品表　'
    ELSE concat('株式会社', regexp_replace(p_brand, '[0-9#]', ''{g}))
  END,
  CASE p_partkey % 4
    WHEN 0 THEN '[scan 300dpi]'
    WHEN 1 THEN 'confidence: 88%'
    WHEN 2 THEN '---'
    ELSE concat('Acme ', p_type, ' Ltd.')
  END,
  concat(p_type, ' ', upper(p_name)),
  'hello'
)"""


def title_block_text(dialect: str) -> str:
    return TITLE_BLOCK_TEXT.format(nl=NL[dialect], g=GFLAG[dialect])


def title_blocks(part: DataFrame) -> DataFrame:
    """D2: ``(doc_id, text)`` title-block text per part."""
    return part.select(F.col("p_partkey").alias("doc_id"),
                       F.expr(title_block_text("spark")).alias("text"))


def title_blocks_sql() -> str:
    return f"SELECT p_partkey AS doc_id, {title_block_text('duck')} AS text FROM part"


# ---------------------------------------------------------------------------
# D3: one block graph per order (doc_id = o_orderkey)
# ---------------------------------------------------------------------------

# block_ord = page * PAGE_SPAN + section * SECTION_SPAN + n * 100 + sub
PAGE_SPAN = 1_000_000
SECTION_SPAN = 100_000
LINES_PER_PAGE = 4
LINE_SORT = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_lines(lineitem: DataFrame) -> DataFrame:
    """Line items numbered per order (``n``, a total order) with the page
    (4 line numbers per page) and the table row they land on."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_SORT)
    page = (F.floor((F.col("l_linenumber") - 1) / LINES_PER_PAGE) + 1).cast("int")
    return (lineitem
            .select(*LINE_SORT, "l_orderkey")
            .withColumn("n", F.row_number().over(w).cast("long"))
            .select(F.col("l_orderkey").alias("doc_id"), "n", page.alias("page"),
                    (F.col("l_linenumber") - LINES_PER_PAGE * (page - 1)).cast("int").alias("row"),
                    "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


def _blk(block_ord, block_type, id_, page, text=None, confidence=None, row=None, col=None,
         entity=None, rels=None):
    """The columns of a block."""
    return [
        block_ord.cast("long").alias("block_ord"),
        F.lit(block_type).alias("block_type"),
        id_.alias("id"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
        page.cast("int").alias("page"),
        (row if row is not None else F.lit(None)).cast("int").alias("row_index"),
        (col if col is not None else F.lit(None)).cast("int").alias("column_index"),
        (F.array(F.lit(entity)) if entity else F.lit(None)).cast("array<string>").alias("entity_types"),
        (rels if rels is not None else F.lit(None)).cast(
            "array<struct<type:string,ids:array<string>>>").alias("relationships"),
    ]


def _rel(kind, *ids):
    return F.struct(F.lit(kind).alias("type"), F.array(*ids).alias("ids"))


def _ord(page, section, n=0, sub=0):
    return (page.cast("long") * PAGE_SPAN + section * SECTION_SPAN
            + (n if not isinstance(n, int) else F.lit(n)) * 100 + sub)


def order_blocks(orders: DataFrame, lineitem: DataFrame, partitions: int | None = None) -> DataFrame:
    """D3 block table: PAGE, LINE, TABLE/CELL/WORD and KEY/VALUE blocks.

    Both inputs are dealt once by the order, into ``partitions`` (default: the
    number of shuffle partitions); all the rest stays there, and what is grouped
    by ``doc_id`` and more afterwards needs no other exchange.  Each kind of
    block is a branch of its own, so that a query that reads some kinds derives
    only those.
    """
    parts = partitions or int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = order_lines(lineitem.select("l_orderkey", *LINE_SORT).repartition(parts, "l_orderkey"))
    s = lambda c: F.col(c).cast("string")
    nid, page, n, c = s("n"), F.col("page"), F.col("n"), F.col("c")
    # LINE + three CELLs + three WORDs per line item
    line_blocks = lines.select("doc_id", *_blk(
        _ord(page, 1, n), "LINE", F.concat(F.lit("L"), nid), page,
        text=F.concat(F.lit("P"), s("l_partkey"), F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus")),
        confidence=F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity") + 50)))
    thrice = lines.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    wid = F.concat(F.lit("W"), nid, F.lit("_"), s("c"))
    word_blocks = thrice.select("doc_id", *_blk(
        _ord(page, 2, n, c), "WORD", wid, page,
        text=F.when(c == 1, s("l_partkey")).when(c == 2, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("l_returnflag")),
        confidence=F.round(F.col("l_discount") * 1000 + c - 1, 3)))
    cell_blocks = thrice.select("doc_id", *_blk(
        _ord(page, 4, n, c), "CELL", F.concat(F.lit("C"), nid, F.lit("_"), s("c")), page,
        row=F.col("row"), col=c, rels=F.array(_rel("CHILD", wid))))

    # one TABLE per page with lines; CHILD ids in line order
    tables = (lines
              .groupBy("doc_id", "page")
              .agg(F.sort_array(F.collect_list(F.struct("n", s("n").alias("ns")))).alias("ns"))
              .select("doc_id", F.col("page"),
                      F.flatten(F.transform("ns", lambda x: F.array(
                          *[F.concat(F.lit("C"), x["ns"], F.lit(f"_{c}")) for c in (1, 2, 3)]
                      ))).alias("cells")))
    table_blocks = tables.select(
        "doc_id", *_blk(_ord(page, 3), "TABLE", F.concat(F.lit("T"), s("page")), page,
                        rels=F.array(F.struct(F.lit("CHILD").alias("type"),
                                              F.col("cells").alias("ids")))))

    # of the numbered lines, so that the exchange of the lines serves here too; a
    # window instead of a join, whose null filter would ask for another exchange
    npages = lines.groupBy("doc_id").agg(F.max(F.when(n > 0, page)).alias("npages"))
    docs = (orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority", F.lit(True).alias("is_order"))
            .repartition(parts, "doc_id")
            .unionByName(npages, allowMissingColumns=True)
            .withColumn("npages", F.max("npages").over(Window.partitionBy("doc_id"))).where("is_order")
            .select("doc_id", "o_orderstatus", "o_orderpriority",
                    F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("npages")), F.lit(1)).cast("int").alias("npages")))
    p1, last = F.lit(1), F.col("npages")
    kv = [
        _blk(_ord(p1, 5, 0), "KEY_VALUE_SET", F.lit("K1"), p1, entity="KEY",
             rels=F.array(_rel("VALUE", F.lit("V1")),
                          _rel("CHILD", F.lit("KW1a"), F.lit("KW1b")))),
        _blk(_ord(p1, 5, 3), "KEY_VALUE_SET", F.lit("V1"), p1, entity="VALUE",
             rels=F.array(_rel("CHILD", F.lit("VW1")))),
        _blk(_ord(p1, 5, 5), "KEY_VALUE_SET", F.lit("K2"), p1, entity="KEY",
             rels=F.array(_rel("CHILD", F.lit("KW2a"), F.lit("KW2b")), _rel("VALUE", F.lit("V2")))),
        _blk(_ord(p1, 5, 8), "KEY_VALUE_SET", F.lit("K3"), p1, entity="KEY",
             rels=F.array(_rel("CHILD", F.lit("KW3")))),
        _blk(_ord(p1, 5, 10), "KEY_VALUE_SET", F.lit("K4"), p1, entity="KEY",
             rels=F.array(_rel("CHILD", F.lit("missing-1"), F.lit("missing-2")))),
        _blk(_ord(p1, 5, 11), "KEY_VALUE_SET", F.lit("K5"), p1, entity="KEY"),
        # the value of K2 sits on the last page
        _blk(_ord(last, 6, 0), "KEY_VALUE_SET", F.lit("V2"), last, entity="VALUE",
             rels=F.array(_rel("CHILD", F.lit("VW2")))),
    ]
    kv_words = [
        _blk(_ord(p1, 5, 1), "WORD", F.lit("KW1a"), p1, text=F.lit("Order"), confidence=F.lit(99.0)),
        _blk(_ord(p1, 5, 2), "WORD", F.lit("KW1b"), p1, text=F.lit("status"), confidence=F.lit(98.0)),
        _blk(_ord(p1, 5, 4), "WORD", F.lit("VW1"), p1, text=F.col("o_orderstatus"),
             confidence=F.lit(97.0)),
        _blk(_ord(p1, 5, 6), "WORD", F.lit("KW2a"), p1, text=F.lit("Order"), confidence=F.lit(0.0)),
        _blk(_ord(p1, 5, 7), "WORD", F.lit("KW2b"), p1, text=F.lit("priority"),
             confidence=F.lit(96.0)),
        _blk(_ord(p1, 5, 9), "WORD", F.lit("KW3"), p1, text=F.lit("Clerk"), confidence=F.lit(95.0)),
        _blk(_ord(last, 6, 1), "WORD", F.lit("VW2"), last, text=F.col("o_orderpriority"),
             confidence=F.lit(94.0)),
    ]

    def of_docs(block_type: str, blocks: list) -> DataFrame:
        # the kind is a constant of the branch, which a filter on it can use
        return (docs.select("doc_id", F.explode(F.array(*[F.struct(*b) for b in blocks])).alias("b"))
                .select("doc_id", "b.*").withColumn("block_type", F.lit(block_type)))

    page_blocks = (docs
                   # every fifth document ends with a blank page: no lines, no words
                   .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("npages") + (F.col("doc_id") % 5 == 0).cast("int"))).alias("page"))
                   .select("doc_id", *_blk(_ord(page, 0), "PAGE", F.concat(F.lit("P"), s("page")), page)))
    out = page_blocks
    for branch in (line_blocks, word_blocks, cell_blocks, table_blocks, of_docs("KEY_VALUE_SET", kv), of_docs("WORD", kv_words)):
        out = out.unionByName(branch)
    return out


# ---------------------------------------------------------------------------
# D8: shape-detection rows per page
# ---------------------------------------------------------------------------

def page_shapes(page_numbers: DataFrame) -> DataFrame:
    """``(doc_id, page_number, enabled, shape_count, dominant_shape)``."""
    k = F.col("doc_id") + F.col("page_number")
    return page_numbers.select(
        "doc_id", "page_number",
        (k % 3 != 0).alias("enabled"),
        ((F.col("doc_id") * 7 + F.col("page_number")) % 5).cast("int").alias("shape_count"),
        F.when(k % 4 == 0, "circle").when(k % 4 == 1, "rectangle").when(k % 4 == 2, "unknown")
        .alias("dominant_shape"))


# ---------------------------------------------------------------------------
# D9: stored responses per order: a chunk per page of line items, some of them
# damaged, failed, empty, unfinished or missing by arithmetic on the order key
# ---------------------------------------------------------------------------

def order_responses(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``(doc_id, chunk_no, body)``: the body is JSON text as received."""
    n = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        (F.floor((F.max("l_linenumber") - 1) / LINES_PER_PAGE) + 1).cast("int").alias("n"))
    docs = (orders.select(F.col("o_orderkey").alias("doc_id")).join(n, "doc_id", "left")
            .withColumn("n", F.coalesce("n", F.lit(1))))
    k, c, n = F.col("doc_id"), F.col("chunk_no"), F.col("n")
    last = c == n - 1
    status = (F.when((k % 17 == 1) & last, "FAILED").when((k % 17 == 2) & last, "IN_PROGRESS")
              .when((k % 17 == 3) & last, F.lit(None)).otherwise("SUCCEEDED"))
    block = F.struct(F.lit("LINE").alias("BlockType"), F.concat(F.lit("L"), c.cast("string")).alias("Id"), F.lit("a \"quoted\" line").alias("Text"))
    body = F.to_json(F.struct(
        status.alias("JobStatus"),
        F.when(k % 17 == 1, F.concat(F.lit("job "), k.cast("string"), F.lit(" failed"))).alias("StatusMessage"),
        F.when(~last | (k % 17 == 4), F.concat(F.lit("page-"), (c + 1).cast("string"))).alias("NextToken"),
        F.when(k % 17 == 5, F.array().cast("array<struct<BlockType:string,Id:string,Text:string>>"))
        .otherwise(F.array(block)).alias("Blocks")), {"ignoreNullFields": "true"})
    damaged = (F.when((k % 17 == 6) & last, F.substring(body, 1, 25)).when((k % 17 == 7) & last, "")
               .when((k % 17 == 8) & last, F.lit(None)).otherwise(body))
    rows = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return (rows.where(~((k % 17 == 9) & last))          # the last chunk never came
            .withColumn("body", damaged)
            # delivered twice: 10 with the same body, 11 with another one
            .withColumn("copies", F.when((k % 17).isin(10, 11) & last, 2).otherwise(1))
            .select("doc_id", "chunk_no", "body", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
            .withColumn("body", F.when((k % 17 == 11) & (F.col("copy") == 2), F.concat("body", F.lit(" "))).otherwise(F.col("body"))).drop("copy"))


# ---------------------------------------------------------------------------
# D6: usage rows (file = order, pages = its line count)
# D7: run log from events: errors, processing times, job status log
# ---------------------------------------------------------------------------

def order_usage(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    counts = lineitem.groupBy(F.col("l_orderkey").alias("file_id")).agg(
        F.count(F.lit(1)).alias("pages"))
    return (orders.select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("ts"))
            .join(counts, "file_id", "left")
            .select("file_id", "ts", F.coalesce("pages", F.lit(0)).cast("long").alias("pages")))


ERROR_TYPE_SQL = """CASE user_id % 5 WHEN 0 THEN 'FILE_ERROR' WHEN 1 THEN 'SIZE_LIMIT_ERROR'
  WHEN 2 THEN 'OCR_ENGINE_ERROR' WHEN 3 THEN 'TIMEOUT_ERROR' END"""
ERROR_NAME_SQL = """CASE event_id % 6 WHEN 0 THEN 'ThrottlingException'
  WHEN 1 THEN 'ServiceUnavailableException' WHEN 2 THEN 'InternalServerError'
  WHEN 3 THEN 'OcrError' WHEN 4 THEN 'ValidationException' ELSE 'Error' END"""
RETRY_FLAG_SQL = "CASE WHEN event_id % 6 = 3 THEN event_id % 4 = 0 END"
ENGINE_SQL = "CASE WHEN user_id % 2 = 0 THEN 'textract' ELSE 'textract-analyze' END"
STATUS_SQL = """CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED'
  ELSE 'IN_PROGRESS' END"""


def run_errors(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") == "error")
            .select("event_id", "ts", F.expr(ERROR_TYPE_SQL).alias("error_type"),
                    F.expr(ERROR_NAME_SQL).alias("error_name"),
                    F.expr(RETRY_FLAG_SQL).alias("retryable_flag")))


def run_times(events: DataFrame) -> DataFrame:
    return (events.filter(F.col("event_type") != "error")
            .select("event_id", "ts", F.expr(ENGINE_SQL).alias("engine"),
                    (F.col("user_id") % 10 + 1).cast("int").alias("page_count"),
                    F.col("value").alias("duration_ms")))


def run_phases(events: DataFrame) -> DataFrame:
    """Two phases a document, by number of the event; failed ones have no time."""
    return (events.filter(F.col("event_type") != "error")
            .select(F.expr("event_id div 2").alias("doc_id"),
                    F.when(F.col("event_id") % 2 == 0, "conversion").otherwise("shapes").alias("phase"),
                    F.col("value").alias("seconds")))


def job_status_log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
                         F.expr(STATUS_SQL).alias("status"),
                         F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"))
