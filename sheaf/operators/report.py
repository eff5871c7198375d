"""Filtered text per document (AGG-17 wide form) and its report (TXT-25).

Context drawing numbers come first, then routed facts in line order; each
category keeps distinct values in first-seen order.  The per-document
arrays are the output format; they hold the document's distinct facts
only (bounded by the document's text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import rules as R
from sheaf.functions.text import has_digit
from sheaf.operators.drawing import context_hits, detected
from sheaf.operators.lines import has_keyword, numbered_lines, route


def ordered_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  range_bytes: int | None = None) -> DataFrame:
    """``(doc_id, category, value, o)`` with one row per distinct fact and
    ``o`` its first-seen order key; a document without facts has one row with
    NULLs.  Context numbers and routed values come from the same pass over the
    lines, and one aggregation keeps the first of each."""
    line = F.col("line")
    routed = (numbered_lines(docs, id_col, text_col, range_bytes, outer=True)
              .withColumn("has_digit", has_digit(line)).withColumn("has_keyword", has_keyword(line))
              .select("*", route(line, F.col("has_digit"), F.col("has_keyword")).alias("r")))

    def fact(category, value, *o):
        return F.struct(category.alias("category"), value.alias("value"),
                        F.struct(*[x.cast("long").alias(n) for x, n in zip(o, "sabc")]).alias("o"))

    ctx = F.when(detected(line), F.transform(
        F.filter(context_hits(line, F.col("below"), F.col("below2")), lambda h: F.length(h["value"]) >= 3),
        lambda h: fact(F.lit("drawing"), h["value"], F.lit(0), h["method"], F.col("line_no"), h["pos"])))
    own = F.transform("r.hits", lambda v, i: fact(F.col("r.category"), v, F.lit(1), F.col("line_no"), i, F.lit(0)))
    none = F.array().cast("array<struct<category:string,value:string,o:struct<s:bigint,a:bigint,b:bigint,c:bigint>>>")
    return (routed.select("doc_id", F.explode_outer(F.concat(F.coalesce(ctx, none), F.coalesce(own, none))).alias("f"))
            .groupBy("doc_id", "f.category", "f.value").agg(F.min("f.o").alias("o")))


def filtered_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  range_bytes: int | None = None) -> DataFrame:
    """Wide form: one row per document (distinct id) with the seven category
    lists."""
    facts = ordered_facts(docs, id_col, text_col, range_bytes)
    wide = (facts.groupBy("doc_id")
            .pivot("category", R.CATEGORIES)
            .agg(F.array_sort(F.collect_list(F.struct("o", "value")))))
    return wide.select(
        "doc_id", *[F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["value"]).alias(c)
                    for c in R.CATEGORIES])


def report(wide: DataFrame) -> DataFrame:
    """TXT-25: ``(doc_id, report)``: non-empty sections in fixed order,
    heading line then one bullet per value, sections split by a blank line."""
    def bulleted(bullet: str):
        return lambda v: F.concat(F.lit(bullet), v)

    sections = [
        F.when(F.size(cat) > 0, F.concat(
            F.lit(heading + "\n"), F.array_join(F.transform(cat, bulleted(bullet)), "\n")))
        for cat, heading, bullet in R.REPORT_SECTIONS
    ]
    return wide.select("doc_id", F.concat_ws("\n\n", *sections).alias("report"))
