"""Text rules for engineering-drawing lines.

The strings in the FIXED VALUES block below must equal the rules the
classified facts are defined by; they are written once here and used both
by the Spark jobs (Java regex) and by the DuckDB oracle (RE2).  Every
pattern below is accepted by both engines with the same meaning.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the rule definitions; do not reorder)
# ---------------------------------------------------------------------------

# JavaScript's \s (ECMAScript WhiteSpace + LineTerminator); Java's \s and
# Spark's trim() miss most of these, Japanese OCR text is full of U+3000.
WS = (r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
# the same set as literal characters (for Spark's trim(BOTH chars FROM s))
WS_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")
# JavaScript's "." (any char except line terminators)
DOT = r"[^\n\r\x{2028}\x{2029}]"

# OCR source header lines that are skipped by the router
HEADER_OPEN = "["
HEADER_DPI = "dpi]"
HEADER_CONF = "confidence:"
HEADER_PCT = "%"
HEADER_RULE = "---"

# Drawing-number label forms
LABEL_FORMS = [
    r"Drawing\s*No\.?:?\s*",
    r"Drawing\s*Number\s*:?\s*",
    r"図面\s*No\.?:?\s*",
    r"図面番号\s*:?\s*",
    r"DWG\s*No\.?:?\s*",
    r"DWG\s*#\s*:?\s*",
]
LABELED_VALUE = r"([A-Z0-9\-_.]+)"
# keyword line (the fallback after a label form fails)
KEYWORD_LINE = r"drawing\s*no|drawing\s*number|図面\s*no|図面番号|dwg\s*no"
DASHED_CODE = r"[A-Z0-9]{2,}-[A-Z0-9]{2,}"

# Ordered line rules: (rule id, category, pattern)
STANDARD_DRAWING = r"[A-Z]{1,3}[0-9]{4,6}-[A-Z][0-9]{3,6}"
EXTENDED_DRAWING = r"[A-Z]{1,4}[0-9]{2,8}-[A-Z]{1,2}[0-9]{2,8}"
SHORT_PART = r"[0-9]{3,4}-[0-9]{3,4}[A-Z]?L?"
LONG_PART = r"[0-9]{4,5}-[0-9]{4}[A-Z]*"
GENERAL_CODE = r"[A-Z0-9]{2,}-[A-Z0-9]{2,}"
DATE = r"[0-9]{2,4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,4}"
DIMENSION = r"φ?[0-9]+\.?[0-9]*[A-Z]?"
THREAD_SPEC = r"[0-9]+-M[0-9]+[A-Z]*-?[A-Z]*\(?[0-9.]*[A-Z]?\)?"
MATERIAL_WORDS = ["フレーム", "材料", "ステンレス", "アルミ", "鋼", "樹脂"]
COMPANY_WORDS = ["株式会社", "会社", "Corporation", "Co.", "Ltd.", "Inc."]
JAPANESE_CHAR = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]"
# general-code exception markers
GENERAL_KEEP_MARKERS = ["KA", "A0"]

# Fuzzy "drawing" detectors (the first seven and the last ignore case)
DRAWING_DETECTORS = [
    r"drawing",
    r"drawin",
    r"drawi",
    r"drawng",
    r"dravving",
    r"drawimg",
    r"dra\s*wi\s*ng",
    r"d.*r.*a.*w.*i.*n.*g",
    r"図面",
    r"dwg",
]
# same-line number after a keyword
KEYWORD_NUMBER = r"(drawing|図面|dwg)\s*no?\.?\s*:?\s*([A-Z0-9\-_.]+)"
KEYWORD_PREFIX = r"(drawing|図面|dwg)\s*no?\.?\s*:?\s*"
# candidate extractors for neighbouring lines, in order
CANDIDATE_PATTERNS = [
    r"[A-Z]{1,4}[0-9]{4,8}-[A-Z]{1,3}[0-9]{3,8}",
    r"[0-9]{3,5}-[0-9]{3,5}[A-Z]*",
    r"[A-Z]{2,}[0-9]{2,}-[A-Z0-9]{2,}",
    r"[A-Z0-9]{3,}-[A-Z0-9]{3,}",
    r"[A-Z0-9]{2,}[-_][A-Z0-9]{2,}",
    r"[A-Z0-9]{2,}\s+[A-Z0-9]{2,}",
]
CANDIDATE_TOKEN = r"[A-Z0-9]{3,25}"
# dash-insertion rewrites of an undashed token (first match only)
DASH_REWRITES = [
    r"([A-Z]+)([0-9]+)",
    r"([0-9]+)([A-Z]+)",
    r"([A-Z0-9]{3,4})([A-Z0-9]{3,})",
]
# whole-text context patterns (case-insensitive); group 1 is the code
CONTEXT_AFTER = r"(?:drawing|図面|dwg).{0,50}?([A-Z0-9\-_.]{5,25})"
CONTEXT_BEFORE = r"([A-Z0-9\-_.]{5,25}).{0,20}(?:drawing|図面|dwg)"

# Report section order and headings (category -> heading, bullet)
REPORT_SECTIONS = [
    ("drawing", "🎯 【最重要】図面番号・部品番号:", "  ★ "),
    ("date", "📅 日付:", "  • "),
    ("dimension", "📏 寸法・仕様:", "  • "),
    ("technical", "⚙️ 技術仕様:", "  • "),
    ("material", "🔧 材料情報:", "  • "),
    ("company", "🏢 会社情報:", "  • "),
    ("japanese", "📝 その他のテキスト:", "  • "),
]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

CATEGORIES = [c for c, _, _ in REPORT_SECTIONS]


def js(pattern: str) -> str:
    r"""Spell a JavaScript pattern for Java and RE2: \s -> WS, . -> DOT."""
    out, i = [], 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s" and not in_class:
                out.append(WS)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        elif ch == "." and not in_class:
            out.append(DOT)
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def labeled_pattern() -> str:
    return ci("(" + "|".join(js(f) for f in LABEL_FORMS) + ")" + LABELED_VALUE)


def label_only_pattern() -> str:
    return ci("(" + "|".join(js(f) for f in LABEL_FORMS) + ")")


def keyword_line_pattern() -> str:
    return ci(js(KEYWORD_LINE))


def fuzzy_subsequence(word: str) -> str:
    """Linear spelling of ``w.o.r.d`` with JS '.' and /i.

    ``d.*r.*a.*w...`` backtracks polynomially on long lines in Java; the
    subsequence test "each letter appears after the previous one within one
    line segment" is the same language and runs in linear time.
    """
    stop = r"\r\x{2028}\x{2029}"
    parts = [f"(?:^|[{stop}])"]
    for ch in word:
        lo, up = ch.lower(), ch.upper()
        parts.append(f"[^{lo}{up}{stop}]*[{lo}{up}]")
    return "".join(parts)


def drawing_detector_pattern() -> str:
    ci_forms, cs_forms = [], []
    for p in DRAWING_DETECTORS:
        if p == r"d.*r.*a.*w.*i.*n.*g":
            ci_forms.append(fuzzy_subsequence("drawing"))
        elif p == "図面":
            cs_forms.append(p)
        else:
            ci_forms.append(js(p))
    return "(?i:" + "|".join(ci_forms) + ")|" + "|".join(cs_forms)


def keyword_number_pattern() -> str:
    return ci(js(KEYWORD_NUMBER))


def keyword_prefix_pattern() -> str:
    return ci(js(KEYWORD_PREFIX))


def context_patterns() -> list[str]:
    return [ci(js(CONTEXT_AFTER)), ci(js(CONTEXT_BEFORE))]


def candidate_patterns() -> list[str]:
    return [js(p) for p in CANDIDATE_PATTERNS]


def first_match_rewrite(pattern: str) -> str:
    """Anchored form so that an engine replacing every match replaces the
    leftmost one only (JS ``String.replace`` with a non-global regex)."""
    return "^(" + DOT + "*?)" + pattern


def any_of(words: list[str]) -> str:
    """Alternation of literal words."""
    specials = set(".^$*+?()[]{}|\\")
    return "|".join("".join("\\" + c if c in specials else c for c in w) for w in words)
