"""Column-expression helpers for text with JavaScript string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.rules import WS, WS_CHARS


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: strip JS whitespace and line terminators
    (plain ``trim`` strips U+0020 only; with the character set it is a
    native scan from both ends, no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def js_trim_regex(c: Column) -> Column:
    """Regex spelling of the same trim (kept for comparison in tests)."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches, left to right (JS ``match`` with /g)."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def has(c: Column, literal: str) -> Column:
    return F.instr(c, literal) > 0


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def not_empty(arr: Column) -> Column:
    return F.coalesce(F.size(arr) > 0, F.lit(False))


def split_lines(text: Column) -> Column:
    """``text.split('\\n')`` as an array (trailing empties kept)."""
    return F.split(text, "\n", -1)


def trimmed_lines(text: Column) -> Column:
    """``split('\\n').map(trim).filter(non-empty)`` as one array per row."""
    return F.filter(F.transform(split_lines(text), js_trim), lambda s: F.length(s) > 0)
