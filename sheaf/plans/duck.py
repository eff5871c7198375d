"""DuckDB (RE2) spellings of the text rules, for the oracle SQL.

The oracle reaches the same facts through DuckDB's regex engine and list
lambdas, so a dialect slip on the Spark side (Java regex, trim, split) shows
up as a mismatch.
"""

from __future__ import annotations

from sheaf.functions import rules as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + R.WS + '+|' + R.WS + '+\\z')}, '', 'g')"


def extract(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def has(x: str, lit: str) -> str:
    return f"(instr({x}, {q(lit)}) > 0)"


def has_digit(x: str) -> str:
    return rlike(x, "[0-9]")


def lfilter(arr: str, cond: str, var: str = "v") -> str:
    return f"list_filter({arr}, lambda {var}: {cond})"


def ltransform(arr: str, expr: str, var: str = "v") -> str:
    return f"list_transform({arr}, lambda {var}: {expr})"


def between_len(v: str, lo: int, hi: int) -> str:
    return f"(length({v}) >= {lo} AND length({v}) <= {hi})"


def nonempty(arr: str) -> str:
    return f"coalesce(len({arr}) > 0, false)"


def lines_sql(table: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """TXT-1 in DuckDB: (doc_id, line_no, line) of non-empty trimmed lines."""
    return f"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, line_no, {trim('raw')} AS line FROM (
    SELECT {id_col} AS doc_id,
           unnest(string_split({text_col}, chr(10))) AS raw,
           unnest(range(1, len(string_split({text_col}, chr(10))) + 1)) AS line_no
    FROM {table}
  )
) WHERE length(line) > 0"""


def is_header(line: str) -> str:
    return (f"((substr({line}, 1, 1) = {q(R.HEADER_OPEN)} AND {has(line, R.HEADER_DPI)})"
            f" OR ({has(line, R.HEADER_CONF)} AND {has(line, R.HEADER_PCT)})"
            f" OR {line} = {q(R.HEADER_RULE)})")


def rule_hits(line: str) -> list[tuple[str, str, str]]:
    labeled = lfilter(
        ltransform(extract(line, R.labeled_pattern()),
                   trim(f"regexp_replace(m, {q(R.label_only_pattern())}, '', 'g')"), "m"),
        "length(v) > 2 AND length(v) < 30")
    keyword = (f"CASE WHEN {rlike(line, R.keyword_line_pattern())} THEN "
               + lfilter(extract(line, R.ci(R.DASHED_CODE)),
                         f"{between_len('v', 3, 25)} AND {has_digit('v')}") + " END")
    general = lfilter(
        extract(line, R.GENERAL_CODE),
        f"({between_len('v', 5, 20)} AND {has_digit('v')} AND NOT {rlike('v', '^[0-9]+-[0-9]+$')})"
        f" OR {has('v', R.GENERAL_KEEP_MARKERS[0])} OR {has('v', R.GENERAL_KEEP_MARKERS[1])}")
    dims = lfilter(extract(line, R.DIMENSION), "length(v) >= 2")
    whole = f"[{line}]"
    return [
        ("TXT-3", "drawing", labeled),
        ("TXT-4", "drawing", keyword),
        ("TXT-5", "drawing", extract(line, R.STANDARD_DRAWING)),
        ("TXT-6", "drawing", extract(line, R.EXTENDED_DRAWING)),
        ("TXT-7", "drawing", extract(line, R.SHORT_PART)),
        ("TXT-8", "drawing", extract(line, R.LONG_PART)),
        ("TXT-9", "drawing", general),
        ("TXT-10", "date", extract(line, R.DATE)),
        ("TXT-11", "dimension", dims),
        ("TXT-12", "technical", extract(line, R.THREAD_SPEC)),
        ("TXT-13", "material", f"CASE WHEN {rlike(line, R.any_of(R.MATERIAL_WORDS))} THEN {whole} END"),
        ("TXT-14", "company", f"CASE WHEN {rlike(line, R.any_of(R.COMPANY_WORDS))} THEN {whole} END"),
        ("TXT-15", "japanese",
         f"CASE WHEN {rlike(line, R.JAPANESE_CHAR)} AND length({line}) >= 2 THEN {whole} END"),
    ]


def routed_sql(lines: str) -> str:
    """TXT-16: (doc_id, line_no, line, rule, category, hits)."""
    hits = rule_hits("line")
    cols = ", ".join(f"{h} AS h{i}" for i, (_, _, h) in enumerate(hits))

    def case(pick):
        arms = " ".join(f"WHEN {nonempty(f'h{i}')} THEN {pick(i, r, c)}"
                        for i, (r, c, _) in enumerate(hits))
        return f"CASE WHEN hdr THEN NULL {arms} END"

    return f"""
SELECT doc_id, line_no, line,
       {case(lambda i, r, c: q(r))} AS rule,
       {case(lambda i, r, c: q(c))} AS category,
       {case(lambda i, r, c: f'h{i}')} AS hits
FROM (SELECT doc_id, line_no, line, {is_header('line')} AS hdr, {cols} FROM ({lines}))"""


def classified_sql(lines: str) -> str:
    """(doc_id, line_no, hit_no, rule, category, value)."""
    return f"""
SELECT doc_id, line_no, CAST(hit_no AS BIGINT) AS hit_no, rule, category, value FROM (
  SELECT doc_id, line_no, rule, category, unnest(hits) AS value,
         unnest(range(1, len(hits) + 1)) AS hit_no
  FROM ({routed_sql(lines)}) WHERE rule IS NOT NULL)"""


def facts_sql(classified: str) -> str:
    return f"""
SELECT doc_id, category, value,
       min(struct_pack(l := line_no, h := hit_no)).l AS first_line,
       min(struct_pack(l := line_no, h := hit_no)).h AS first_hit,
       count(*) AS n_hits
FROM ({classified}) GROUP BY doc_id, category, value"""


# ---------------------------------------------------------------------------
# context-aware drawing numbers (TXT-17..24)
# ---------------------------------------------------------------------------

EMPTY = "[]::VARCHAR[]"


def concat(*arrs: str) -> str:
    out = f"coalesce({arrs[0]}, {EMPTY})"
    for a in arrs[1:]:
        out = f"list_concat({out}, coalesce({a}, {EMPTY}))"
    return out


def same_line_numbers(line: str) -> str:
    after = lfilter(ltransform(extract(line, R.keyword_number_pattern()),
                               trim(f"regexp_replace(m, {q(R.keyword_prefix_pattern())}, '', 'g')"), "m"),
                    "length(v) >= 3")
    dashed = lfilter(extract(line, R.DASHED_CODE), f"{between_len('v', 5, 25)} AND {has_digit('v')}")
    return concat(after, dashed)


def potential_numbers(s: str) -> str:
    per = [lfilter(ltransform(extract(s, p),
                              f"regexp_replace(regexp_replace(m, {q(R.WS + '+')}, '-', 'g'), '_', '-', 'g')",
                              "m"),
                   f"{between_len('v', 5, 25)} AND {has_digit('v')}")
           for p in R.candidate_patterns()]
    tokens = lfilter(extract(s, R.CANDIDATE_TOKEN),
                     f"{rlike('t', '[A-Z]')} AND {has_digit('t')} AND length(t) >= 5", "t")
    variants = ", ".join(f"regexp_replace(t, {q(R.first_match_rewrite(p))}, '\\1\\2-\\3')"
                         for p in R.DASH_REWRITES)
    rewrites = (f"flatten(list_transform({tokens}, lambda t: "
                f"list_filter([{variants}], lambda w: instr(w, '-') > 0 AND length(w) <= 25)))")
    return concat(*per, rewrites)


def right_side(line: str) -> str:
    pos = f"strpos(lower({line}), 'drawing')"
    return f"substr({line}, CASE WHEN {pos} = 0 THEN 7 ELSE {pos} + 7 END)"


def drawing_numbers_sql(table: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    ls = f"list_filter(list_transform(string_split({text_col}, chr(10)), lambda x: {trim('x')}), lambda x: length(x) > 0)"
    cand = concat(
        same_line_numbers("line"),
        f"CASE WHEN below IS NOT NULL THEN {potential_numbers('below')} END",
        f"CASE WHEN below2 IS NOT NULL THEN {potential_numbers('below2')} END",
        f"CASE WHEN length({right_side('line')}) > 2 THEN {potential_numbers(right_side('line'))} END")
    ctx = "\n  UNION ALL ".join(
        f"""SELECT doc_id, {2 + k} AS method, 0 AS line_no, unnest(range(0, len(c))) AS pos, unnest(c) AS value
  FROM (SELECT {id_col} AS doc_id,
               {lfilter(extract(text_col, p, 1), f"{has_digit('v')} AND instr(v, '-') > 0")} AS c
        FROM {table})"""
        for k, p in enumerate(R.context_patterns()))
    return f"""
WITH d AS (SELECT {id_col} AS doc_id, {ls} AS ls FROM {table}),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no, ls FROM d),
n AS (SELECT doc_id, line_no, line, ls[line_no + 2] AS below, ls[line_no + 3] AS below2
      FROM l WHERE {rlike('line', R.drawing_detector_pattern())}),
c AS (SELECT doc_id, line_no, {cand} AS c FROM n),
allc AS (
  SELECT doc_id, 1 AS method, line_no, unnest(range(0, len(c))) AS pos, unnest(c) AS value FROM c
  UNION ALL {ctx}),
f AS (SELECT doc_id, value, min(struct_pack(m := method, l := line_no, p := pos)) AS o
      FROM allc WHERE length(value) >= 3 GROUP BY doc_id, value)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS BIGINT) AS seq, value FROM f"""


def wide_sql(table: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """AGG-17 wide form, each list joined by '|' (flat for comparison)."""
    fx = facts_sql(classified_sql(lines_sql(table, id_col, text_col)))
    ctx = drawing_numbers_sql(table, id_col, text_col)
    lists = ", ".join(
        f"coalesce(array_to_string(list(value ORDER BY o) FILTER (WHERE category = {q(c)}), '|'), '') AS {c}"
        for c in R.CATEGORIES)
    cols = ", ".join(f"coalesce(w.{c}, '') AS {c}" for c in R.CATEGORIES)
    return f"""
WITH u AS (
  SELECT doc_id, 'drawing' AS category, value, struct_pack(s := 0, a := seq, b := CAST(0 AS BIGINT)) AS o
  FROM ({ctx})
  UNION ALL
  SELECT doc_id, category, value, struct_pack(s := 1, a := first_line, b := first_hit) AS o FROM ({fx})),
f AS (SELECT doc_id, category, value, min(o) AS o FROM u GROUP BY ALL),
w AS (SELECT doc_id, {lists} FROM f GROUP BY doc_id)
SELECT d.doc_id, {cols}
FROM (SELECT {id_col} AS doc_id FROM {table}) d LEFT JOIN w ON w.doc_id = d.doc_id"""


def report_sql(table: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """TXT-25 via AGG-17 in DuckDB."""
    fx = facts_sql(classified_sql(lines_sql(table, id_col, text_col)))
    ctx = drawing_numbers_sql(table, id_col, text_col)
    lists = ", ".join(
        f"list(value ORDER BY o) FILTER (WHERE category = {q(c)}) AS {c}" for c in R.CATEGORIES)
    secs = ", ".join(
        f"CASE WHEN len(coalesce({c}, {EMPTY})) > 0 THEN {q(h + chr(10))} || "
        f"array_to_string(list_transform({c}, lambda v: {q(b)} || v), chr(10)) END"
        for c, h, b in R.REPORT_SECTIONS)
    return f"""
WITH u AS (
  SELECT doc_id, 'drawing' AS category, value, struct_pack(s := 0, a := seq, b := CAST(0 AS BIGINT)) AS o
  FROM ({ctx})
  UNION ALL
  SELECT doc_id, category, value, struct_pack(s := 1, a := first_line, b := first_hit) AS o FROM ({fx})),
f AS (SELECT doc_id, category, value, min(o) AS o FROM u GROUP BY ALL),
w AS (SELECT doc_id, {lists} FROM f GROUP BY doc_id)
SELECT d.doc_id, concat_ws(chr(10) || chr(10), {secs}) AS report
FROM (SELECT {id_col} AS doc_id FROM {table}) d LEFT JOIN w ON w.doc_id = d.doc_id"""
