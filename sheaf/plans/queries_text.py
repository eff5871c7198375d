"""Registered text queries: line routing and facts (TXT-1..16, AGG-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import drawing as DR
from sheaf.operators import lines as L
from sheaf.operators import report as RP
from sheaf.plans import duck as D
from sheaf.plans.registry import register
from sheaf.sources.derived import title_blocks, title_blocks_sql
from sheaf.sources.tables import table


@register("line_facts", "TXT-1..16, SET-2 on documents",
          lambda: D.facts_sql(D.classified_sql(D.lines_sql("documents"))))
def line_facts(spark, sf_dir):
    return L.line_facts(table(spark, sf_dir, "documents"))


@register("line_hits", "TXT-1..16 routed hits on documents",
          lambda: D.classified_sql(D.lines_sql("documents")))
def line_hits(spark, sf_dir):
    return L.classify_lines(table(spark, sf_dir, "documents"))


@register("line_route_counts", "TXT-16 routing totals on documents",
          lambda: f"""
SELECT coalesce(category, 'none') AS category, coalesce(rule, 'none') AS rule, count(*) AS n_lines
FROM ({D.routed_sql(D.lines_sql('documents'))}) GROUP BY ALL""")
def line_route_counts(spark, sf_dir):
    return (L.line_routes(table(spark, sf_dir, "documents"))
            .groupBy("category", F.coalesce("rule", F.lit("none")).alias("rule"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


@register("title_block_facts", "TXT-1..16 on title blocks derived from part",
          lambda: D.facts_sql(D.classified_sql(D.lines_sql(f"({title_blocks_sql()})"))))
def title_block_facts(spark, sf_dir):
    return L.line_facts(title_blocks(table(spark, sf_dir, "part")))


@register("title_block_all_matches", "every rule without routing (TXT-8 visible)",
          lambda: f"""
SELECT doc_id, line_no, CAST(hit_no AS BIGINT) AS hit_no, rule, category, value FROM (
  SELECT doc_id, line_no, r.rule AS rule, r.category AS category, unnest(r.hits) AS value,
         unnest(range(1, len(r.hits) + 1)) AS hit_no
  FROM (
    SELECT doc_id, line_no, unnest(rs) AS r FROM (
      SELECT doc_id, line_no, [{', '.join(
            f"struct_pack(rule := {D.q(r)}, category := {D.q(c)}, hits := coalesce({h}, []::VARCHAR[]))"
            for r, c, h in D.rule_hits('line'))}] AS rs
      FROM ({D.lines_sql(f'({title_blocks_sql()})')}))))""")
def title_block_all_matches(spark, sf_dir):
    return L.all_matches(title_blocks(table(spark, sf_dir, "part")))


@register("drawing_numbers", "TXT-17..24, WIN-2 on documents",
          lambda: D.drawing_numbers_sql("documents"))
def drawing_numbers(spark, sf_dir):
    return DR.drawing_numbers(table(spark, sf_dir, "documents"))


@register("title_block_drawing_numbers", "TXT-17..24 on title blocks derived from part",
          lambda: D.drawing_numbers_sql(f"({title_blocks_sql()})"))
def title_block_drawing_numbers(spark, sf_dir):
    return DR.drawing_numbers(title_blocks(table(spark, sf_dir, "part")))


@register("title_block_report", "AGG-17 wide lists + TXT-25 report on title blocks",
          lambda: D.report_sql(f"({title_blocks_sql()})"))
def title_block_report(spark, sf_dir):
    return RP.report(RP.filtered_text(title_blocks(table(spark, sf_dir, "part"))))


@register("document_report", "AGG-17 + TXT-25 on documents",
          lambda: D.report_sql("documents"))
def document_report(spark, sf_dir):
    return RP.report(RP.filtered_text(table(spark, sf_dir, "documents")))


@register("title_block_wide", "AGG-17 wide form: seven ordered category lists per document",
          lambda: D.wide_sql(f"({title_blocks_sql()})"))
def title_block_wide(spark, sf_dir):
    from sheaf.functions.rules import CATEGORIES
    w = RP.filtered_text(title_blocks(table(spark, sf_dir, "part")))
    return w.select("doc_id", *[F.array_join(c, "|").alias(c) for c in CATEGORIES])
