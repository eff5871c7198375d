"""Context-aware drawing-number extraction (TXT-17..24, WIN-2).

A line that looks like "drawing" (fuzzy, TXT-17) contributes candidates
from itself (TXT-18), the next and second-next non-empty lines (TXT-19)
and the text right of the word (TXT-20); then two whole-text context
patterns add codes near the word (TXT-23).  Values keep first-seen order
and need at least 3 characters (TXT-24).

The look-ahead (WIN-2) reads neighbours from the document's own line
array, so no window shuffle is needed; only the de-duplication of the
candidates (few per document) shuffles, after map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import rules as R
from sheaf.functions.text import extract_all, has, has_digit, js_trim
from sheaf.operators.lines import numbered_lines

def _empty() -> Column:
    return F.array().cast("array<string>")


def _arr(c: Column) -> Column:
    return F.coalesce(c, _empty())


def _len_between(v: Column, lo: int, hi: int) -> Column:
    return (F.length(v) >= lo) & (F.length(v) <= hi)


def same_line_numbers(line: Column) -> Column:
    """TXT-18: numbers after the keyword, then dashed codes on the line."""
    after = F.filter(
        F.transform(extract_all(line, R.keyword_number_pattern()),
                    lambda m: js_trim(F.regexp_replace(m, R.keyword_prefix_pattern(), ""))),
        lambda v: F.length(v) >= 3)
    dashed = F.filter(extract_all(line, R.DASHED_CODE),
                      lambda v: _len_between(v, 5, 25) & has_digit(v))
    return F.concat(_arr(after), _arr(dashed))


def potential_numbers(s: Column) -> Column:
    """TXT-21 + TXT-22: candidate codes in a piece of text.  Every kept
    candidate contains a digit, so text without one is skipped."""
    return F.when(has_digit(s), _potential_numbers(s)).otherwise(_empty())


def _potential_numbers(s: Column) -> Column:
    per_pattern = [
        F.filter(F.transform(extract_all(s, p),
                             lambda m: F.regexp_replace(F.regexp_replace(m, R.WS + "+", "-"), "_", "-")),
                 lambda v: _len_between(v, 5, 25) & has_digit(v))
        for p in R.candidate_patterns()
    ]
    tokens = F.filter(extract_all(s, R.CANDIDATE_TOKEN),
                      lambda t: t.rlike("[A-Z]") & has_digit(t) & (F.length(t) >= 5))
    rewrites = F.flatten(F.transform(tokens, lambda t: F.filter(
        F.array(*[F.regexp_replace(t, R.first_match_rewrite(p), "$1$2-$3")
                  for p in R.DASH_REWRITES]),
        lambda v: has(v, "-") & (F.length(v) <= 25))))
    return F.concat(*[_arr(x) for x in per_pattern], _arr(rewrites))


def right_side(line: Column) -> Column:
    """TXT-20: text after 'drawing' (JS indexOf; when absent the slice
    starts at char 6 because -1 + 7 = 6)."""
    pos = F.locate("drawing", F.lower(line))
    start = F.when(pos == 0, F.lit(7)).otherwise(pos + 7)
    return line.substr(start, F.length(line))


def _line_candidates(line: Column, below: Column, below2: Column) -> Column:
    rest = right_side(line)
    return F.concat(
        same_line_numbers(line),
        F.when(below.isNotNull(), potential_numbers(below)).otherwise(_empty()),
        F.when(below2.isNotNull(), potential_numbers(below2)).otherwise(_empty()),
        F.when(F.length(rest) > 2, potential_numbers(rest)).otherwise(_empty()))


def context_hits(line: Column, below: Column, below2: Column) -> Column:
    """A line's candidates as ``array<struct<method, pos, value>>``.

    ``method`` 1 = near a detected line, 2/3 = context pattern after/before
    the keyword.  The context patterns never cross a line end, so those of the
    whole text are those of its lines."""
    def numbered(method: int, values: Column) -> Column:
        return F.transform(_arr(values), lambda v, i: F.struct(F.lit(method).alias("method"), i.cast("long").alias("pos"), v.alias("value")))

    keyword = line.rlike(R.ci("drawing|図面|dwg"))
    ctx = [F.when(keyword, F.filter(extract_all(line, p, 1), lambda v: has_digit(v) & has(v, "-")))
           for p in R.context_patterns()]
    return F.concat(numbered(1, _line_candidates(line, below, below2)), *[numbered(2 + k, c) for k, c in enumerate(ctx)])


def detected(line: Column) -> Column:
    """TXT-17; every keyword of the context patterns is detected too."""
    return line.rlike(R.drawing_detector_pattern())


def context_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       range_bytes: int | None = None) -> DataFrame:
    """All candidates in discovery order: ``(doc_id, method, line_no, pos, value)``,
    from one pass over the lines."""
    lines = numbered_lines(docs, id_col, text_col, range_bytes).filter(detected(F.col("line")))
    return (lines.select("doc_id", "line_no", F.explode(context_hits(F.col("line"), F.col("below"), F.col("below2"))).alias("h"))
            .select("doc_id", "h.method", "line_no", "h.pos", "h.value"))


def drawing_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    range_bytes: int | None = None) -> DataFrame:
    """TXT-24: ``(doc_id, seq, value)``: distinct values (len >= 3) in
    first-seen order, ``seq`` 1-based.  ``range_bytes``: see ``lines.pieces``."""
    firsts = (context_candidates(docs, id_col, text_col, range_bytes)
              .filter(F.length("value") >= 3)
              .groupBy("doc_id", "value")
              .agg(F.min(F.struct("method", "line_no", "pos")).alias("o")))
    w = Window.partitionBy("doc_id").orderBy("o")
    return firsts.select("doc_id", F.row_number().over(w).cast("long").alias("seq"), "value")
