"""Line router for drawing text (TXT-1..16, AGG-17, SET-2).

A document's text is split into trimmed non-empty lines; each line goes to
the first rule that yields a value and to no other rule.  Everything is a
narrow projection over the document rows; the only shuffle is the final
de-duplication of facts (small: one row per distinct fact, combined
map-side first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import rules as R
from sheaf.session import spread
from sheaf.functions.text import extract_all, has, has_digit, js_trim, not_empty, split_lines

CUT_BYTES = 8 << 20  # of pieces handed on at a time

ROUTE_TYPE = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("hits", T.ArrayType(T.StringType())),
])


def pieces(docs: DataFrame, range_bytes: int | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, before, own, text)``: texts in pieces of whole lines.

    ``before`` counts the lines before the piece and ``own`` the piece's own
    lines; what follows them is a halo of up to two non-empty lines, read as
    neighbours only.  ``own`` is NULL for a text in one piece.

    With ``range_bytes``, texts above it are cut at the first line end after
    each so many bytes and their pieces dealt anew, so that one giant text
    keeps many tasks busy; shorter texts are not shuffled.  No rule looks
    beyond a line and the two non-empty lines below it, so the results do not
    depend on the cuts.  A line is never cut."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = d if range_bytes is None else d.filter(F.col("text").isNull() | (F.octet_length("text") <= range_bytes))
    out = spread(whole).select("doc_id", F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("own"), "text")
    if range_bytes is None:
        return out
    id_type = d.schema["doc_id"].dataType.simpleString()
    cut = (d.filter(F.octet_length("text") > range_bytes)
           .mapInArrow(lambda batches: _cut(batches, range_bytes), f"doc_id {id_type}, before long, own long, text string")
           .repartition("doc_id", "before"))
    return out.unionByName(cut)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The pieces of each text, a batch of about ``CUT_BYTES`` at a time."""
    for batch in batches:
        for i, text in enumerate(batch["text"]):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 10), len(raw))  # of the lines
            rows, held, first = [], 0, 0
            while first < len(ends):
                start = int(ends[first - 1]) + 1 if first else 0
                last = min(int(np.searchsorted(ends, start + size)), len(ends) - 1)
                halo, wanted = last, 2
                while wanted and halo + 1 < len(ends):
                    halo += 1
                    wanted -= bool(raw[int(ends[halo - 1]) + 1:int(ends[halo])].tobytes().decode().strip(R.WS_CHARS))
                rows.append((first, last + 1 - first, raw[start:int(ends[halo])].tobytes().decode()))
                held, first = held + int(ends[halo]) - start, last + 1
                if held >= CUT_BYTES or first == len(ends):
                    before, own, body = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch["doc_id"][i].as_py()] * len(rows), batch["doc_id"].type), pa.array(before, pa.int64()),
                         pa.array(own, pa.int64()), pa.array(body, pa.string())], names=["doc_id", "before", "own", "text"])
                    rows, held = [], 0


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   range_bytes: int | None = None, outer: bool = False) -> DataFrame:
    """TXT-1 with WIN-2: ``(doc_id, line_no, line, below, below2)``, each
    non-empty line beside the next two.  The neighbours come from the piece's
    own line array, so no window shuffles the text.  ``outer`` keeps a row
    with NULLs for a text without lines."""
    ls = (pieces(docs, range_bytes, id_col, text_col)
          .select("doc_id", "before", "own", F.filter(
              F.transform(split_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), js_trim(x).alias("line"))),
              lambda x: F.length(x["line"]) > 0).alias("ls")))
    near = F.transform("ls", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["line"].alias("line"),
        F.get(F.col("ls"), i + 1)["line"].alias("below"),
        F.get(F.col("ls"), i + 2)["line"].alias("below2")))
    rows = ls.select("doc_id", "before", "own", (F.explode_outer if outer else F.explode)(near).alias("l"))
    return (rows.filter(F.col("own").isNull() | F.col("l.pos").isNull() | (F.col("l.pos") < F.col("own")))
            .select("doc_id", (F.col("before") + F.col("l.pos") + 1).alias("line_no"), "l.line", "l.below", "l.below2"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               range_bytes: int | None = None) -> DataFrame:
    """TXT-1: ``(doc_id, line_no, line)`` for every non-empty trimmed line.

    ``line_no`` is the 1-based position in ``text.split('\\n')``.
    """
    return (pieces(docs, range_bytes, id_col, text_col)
            .select("doc_id", "before", "own", F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
            .filter(F.col("own").isNull() | (F.col("pos") < F.col("own")))
            .select("doc_id",
                    (F.col("before") + F.col("pos") + 1).alias("line_no"),
                    js_trim(F.col("raw")).alias("line"))
            .filter(F.length("line") > 0)
            .withColumn("has_digit", has_digit(F.col("line")))
            .withColumn("has_keyword", has_keyword(F.col("line"))))


def is_header(line: Column) -> Column:
    """TXT-2: OCR source headers skipped by the router."""
    return ((F.substring(line, 1, 1) == R.HEADER_OPEN) & has(line, R.HEADER_DPI)
            | (has(line, R.HEADER_CONF) & has(line, R.HEADER_PCT))
            | (line == R.HEADER_RULE))


def _len_between(v: Column, lo: int, hi: int) -> Column:
    return (F.length(v) >= lo) & (F.length(v) <= hi)


def has_keyword(line: Column) -> Column:
    """Cheap superset test for the label rules: they need 'drawing', '図面'
    or 'dwg' (Unicode lower-casing covers Java's ASCII-only (?i))."""
    low = F.lower(line)
    return (F.instr(low, "drawing") > 0) | (F.instr(line, "図面") > 0) | (F.instr(low, "dwg") > 0)


def _any_literal(line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(line, w) > 0)
    return out


def rule_hits(line: Column, digit: Column | None = None,
              keyword_hit: Column | None = None) -> list[tuple[str, str, Column]]:
    """Ordered ``(rule, category, hits)``; ``hits`` is the array of values a
    rule yields for the line (empty or NULL when it does not fire).

    ``digit`` (optional): a precomputed "line has a digit" column.  Seven
    rules cannot match without a digit; gating them skips seven regex scans
    on the (typical) digit-free line without changing any result."""
    need_digit = (lambda h: F.when(digit, h)) if digit is not None else (lambda h: h)
    need_kw = (lambda h: F.when(keyword_hit, h)) if keyword_hit is not None else (lambda h: h)
    labeled = F.filter(
        F.transform(extract_all(line, R.labeled_pattern()),
                    lambda m: js_trim(F.regexp_replace(m, R.label_only_pattern(), ""))),
        lambda v: (F.length(v) > 2) & (F.length(v) < 30))
    keyword = F.when(
        line.rlike(R.keyword_line_pattern()),
        F.filter(extract_all(line, R.ci(R.DASHED_CODE)),
                 lambda v: _len_between(v, 3, 25) & has_digit(v)))
    general = F.filter(
        extract_all(line, R.GENERAL_CODE),
        # JS precedence: (a && b && c && d) || e || f
        lambda v: (_len_between(v, 5, 20) & has_digit(v) & ~v.rlike("^[0-9]+-[0-9]+$"))
        | has(v, R.GENERAL_KEEP_MARKERS[0]) | has(v, R.GENERAL_KEEP_MARKERS[1]))
    dims = F.filter(extract_all(line, R.DIMENSION), lambda v: F.length(v) >= 2)
    whole = F.array(line)
    return [
        ("TXT-3", "drawing", need_kw(labeled)),
        ("TXT-4", "drawing", need_kw(keyword)),
        ("TXT-5", "drawing", need_digit(extract_all(line, R.STANDARD_DRAWING))),
        ("TXT-6", "drawing", need_digit(extract_all(line, R.EXTENDED_DRAWING))),
        ("TXT-7", "drawing", need_digit(extract_all(line, R.SHORT_PART))),
        ("TXT-8", "drawing", need_digit(extract_all(line, R.LONG_PART))),
        ("TXT-9", "drawing", F.when(F.instr(line, "-") > 0, general)),
        ("TXT-10", "date", need_digit(extract_all(line, R.DATE))),
        ("TXT-11", "dimension", need_digit(dims)),
        ("TXT-12", "technical", need_digit(extract_all(line, R.THREAD_SPEC))),
        ("TXT-13", "material", F.when(_any_literal(line, R.MATERIAL_WORDS), whole)),
        ("TXT-14", "company", F.when(_any_literal(line, R.COMPANY_WORDS), whole)),
        ("TXT-15", "japanese", F.when(line.rlike(R.JAPANESE_CHAR) & (F.length(line) >= 2), whole)),
    ]


def route(line: Column, digit: Column | None = None, keyword_hit: Column | None = None) -> Column:
    """TXT-16: first rule with a value takes the line; NULL when none."""
    expr = F.when(is_header(line), F.lit(None).cast(ROUTE_TYPE))
    for rule, category, hits in rule_hits(line, digit, keyword_hit):
        expr = expr.when(not_empty(hits),
                         F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"),
                                  hits.alias("hits")))
    return expr


def classify_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   range_bytes: int | None = None) -> DataFrame:
    """Routed hits: ``(doc_id, line_no, hit_no, rule, category, value)``."""
    routed = (text_lines(docs, id_col, text_col, range_bytes)
              .select("doc_id", "line_no", route(F.col("line"), F.col("has_digit"), F.col("has_keyword")).alias("r"))
              .filter(F.col("r").isNotNull()))
    return (routed
            .select("doc_id", "line_no", F.col("r.rule").alias("rule"),
                    F.col("r.category").alias("category"),
                    F.posexplode("r.hits").alias("pos", "value"))
            .select("doc_id", "line_no", (F.col("pos") + 1).cast("long").alias("hit_no"),
                    "rule", "category", "value"))


def line_routes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty line with the rule that took it (NULL = none)."""
    return (text_lines(docs, id_col, text_col)
            .select("doc_id", "line_no", "line", route(F.col("line"), F.col("has_digit"), F.col("has_keyword")).alias("r"))
            .select("doc_id", "line_no", "line",
                    F.col("r.rule").alias("rule"),
                    F.coalesce(F.col("r.category"), F.lit("none")).alias("category")))


def dedupe_facts(hits: DataFrame) -> DataFrame:
    """SET-2: distinct ``(doc_id, category, value)`` keeping the first
    occurrence; partial aggregation runs before the shuffle."""
    return (hits
            .groupBy("doc_id", "category", "value")
            .agg(F.min(F.struct("line_no", "hit_no")).alias("first"),
                 F.count(F.lit(1)).alias("n_hits"))
            .select("doc_id", "category", "value",
                    F.col("first.line_no").alias("first_line"),
                    F.col("first.hit_no").alias("first_hit"),
                    "n_hits"))


def line_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               range_bytes: int | None = None) -> DataFrame:
    """Long form of the filtered text: ``(doc_id, category, value, first_line,
    first_hit, n_hits)``.  ``range_bytes``: see ``pieces``."""
    return dedupe_facts(classify_lines(docs, id_col, text_col, range_bytes))


def all_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every rule's hits on every line, without the router (shows rules
    that the router order shadows, e.g. the long part number)."""
    lines = text_lines(docs, id_col, text_col)
    arr = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(cat).alias("category"),
                             F.coalesce(hits, F.array().cast("array<string>")).alias("hits"))
                    for rule, cat, hits in rule_hits(F.col("line"))])
    return (lines.select("doc_id", "line_no", F.explode(arr).alias("r"))
            .select("doc_id", "line_no", "r.rule", "r.category",
                    F.posexplode("r.hits").alias("pos", "value"))
            .select("doc_id", "line_no", (F.col("pos") + 1).cast("long").alias("hit_no"),
                    "rule", "category", "value"))
