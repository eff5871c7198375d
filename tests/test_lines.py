"""Router goldens (hand-computed from the rule definitions)."""

import pytest

from sheaf.operators import lines as L

U3000 = "　"

GOLDEN = [
    ("[scan 300dpi]", None, []),
    ("confidence: 88%", None, []),
    ("---", None, []),
    ("Drawing No: KA21941-A004002", ("TXT-3", "drawing"), ["KA21941-A004002"]),
    ("Drawing Number: KA21941-A004002", ("TXT-3", "drawing"), ["KA21941-A004002"]),
    ("Drawing Notes", ("TXT-3", "drawing"), ["tes"]),
    (f"図面{U3000}No:{U3000}X-77", ("TXT-3", "drawing"), ["X-77"]),
    ("図面番号：ka-12 rev", ("TXT-4", "drawing"), ["ka-12"]),
    ("KA21941-A004002", ("TXT-5", "drawing"), ["KA21941-A004002"]),
    ("AB12-C34", ("TXT-6", "drawing"), ["AB12-C34"]),
    ("110-510 352-3254L", ("TXT-7", "drawing"), ["110-510", "352-3254L"]),
    ("71950-0006", ("TXT-7", "drawing"), ["1950-0006"]),
    ("AB-12X", ("TXT-9", "drawing"), ["AB-12X"]),
    ("KA-XX", ("TXT-9", "drawing"), ["KA-XX"]),
    ("10-M12", ("TXT-9", "drawing"), ["10-M12"]),
    ("2023/09/14", ("TXT-10", "date"), ["2023/09/14"]),
    ("2024-01-15", ("TXT-10", "date"), ["2024-01-15"]),
    ("φ12.5 x 30", ("TXT-11", "dimension"), ["φ12.5", "30"]),
    ("4-M12", ("TXT-11", "dimension"), ["12"]),
    ("4-M6", ("TXT-12", "technical"), ["4-M6"]),
    ("材料: ステンレス", ("TXT-13", "material"), ["材料: ステンレス"]),
    ("株式会社サンプル", ("TXT-14", "company"), ["株式会社サンプル"]),
    ("Acme Ltd.", ("TXT-14", "company"), ["Acme Ltd."]),
    ("部品表", ("TXT-15", "japanese"), ["部品表"]),
    ("hello", None, []),
]


@pytest.fixture(scope="module")
def routed(spark):
    text = "\n".join(f"  {line}{U3000}" for line, _, _ in GOLDEN)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = L.classify_lines(df).collect()
    by_line = {}
    for r in rows:
        by_line.setdefault(r.line_no, []).append(r)
    return by_line


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_router_golden(routed, i):
    line, rule, values = GOLDEN[i]
    got = sorted(routed.get(i + 1, []), key=lambda r: r.hit_no)
    if rule is None:
        assert got == []
    else:
        assert {(r.rule, r.category) for r in got} == {rule}
        assert [r.value for r in got] == values


def test_each_line_routed_once(spark):
    df = spark.createDataFrame([(1, "AB-12X 2023/09/14 φ12\n4-M6")], "doc_id long, text string")
    rows = L.line_routes(df).collect()
    assert [(r.line_no, r.category) for r in sorted(rows)] == [(1, "drawing"), (2, "technical")]


def test_facts_dedupe_first_seen(spark):
    df = spark.createDataFrame([(7, "30\nφ5 30\n30")], "doc_id long, text string")
    rows = {r.value: r for r in L.line_facts(df).collect()}
    assert rows["30"].first_line == 1 and rows["30"].n_hits == 3
    assert rows["φ5"].first_line == 2


def test_trim_is_js_whitespace(spark):
    df = spark.createDataFrame([(1, "　  x ﻿\n\t\n")], "doc_id long, text string")
    assert [r.line for r in L.text_lines(df).collect()] == ["x"]


def test_native_trim_equals_regex_trim(spark):
    from pyspark.sql import functions as F
    from sheaf.functions.text import js_trim, js_trim_regex
    samples = ["　 x　", "\t\r\nab c ", "\u0085x\u0085", "﻿ y ", "", "   ", "é　"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select(js_trim(F.col("s")).alias("a"), js_trim_regex(F.col("s")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert rows[2].a == "\u0085x\u0085"   # NEL is not JS whitespace


def _joined(spark, sf="/root/testdata/sf0.01"):
    """The documents of each language as one text, with drawing lines, blank
    lines and white space between them."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    between = ["\nDrawing No: KA21941-A004002\n\n \t\n110-510\n", "\r\n図面 7005-0040\n　\n\nAB12CD34\nKA-99 X\n", "\n\n", "\ndwg A1-2345 dwg see 110-510 drawing\n"]
    texts = {}
    for i, r in enumerate(sorted(rows, key=lambda r: r["doc_id"])):
        texts[r["lang"]] = texts.get(r["lang"], "") + (r["text"] or "") + between[i % 4]
    odd = ["", None, "\n" * 5000, "x" * 5000, "drawing\n" + " \n" * 4000 + "110-510\n\n" + "AB12-C34", "図面\n" * 600]
    return spark.createDataFrame(list(enumerate([t for _, t in sorted(texts.items(), key=str)] + odd)), "doc_id long, text string")


def test_giant_texts_in_ranges(spark):
    """Facts, drawing numbers and reports do not depend on the cuts."""
    from sheaf.operators import drawing as DR
    from sheaf.operators import report as RP
    df = _joined(spark).cache()
    for run in (L.line_facts, DR.drawing_numbers, RP.filtered_text):
        whole = sorted(map(str, run(df).collect()))
        assert whole and sorted(map(str, run(df, range_bytes=1000).collect())) == whole, run
    assert sorted(map(str, DR.drawing_numbers(df, range_bytes=1).collect())) == sorted(map(str, DR.drawing_numbers(df).collect()))
    texts, found = {r["doc_id"]: r["text"] for r in df.collect()}, {}
    for r in sorted(L.pieces(df, 1000).where("own is not null").collect(), key=lambda r: r["before"]):
        own = r["text"].split("\n")[:r["own"]]
        assert len("\n".join(own[:-1]).encode()) <= 1000  # lines are whole, so the last may go beyond
        assert r["before"] == len(found.setdefault(r["doc_id"], []))
        found[r["doc_id"]] += own
    assert len(found) > 5 and all("\n".join(ls) == texts[i] for i, ls in found.items())
    df.unpersist()


def test_context_patterns_line_by_line(spark):
    """The context patterns over whole texts give what they give line by line."""
    from pyspark.sql import functions as F

    from sheaf.functions import rules as R
    from sheaf.functions.text import extract_all, split_lines
    df = _joined(spark)
    for p in R.context_patterns():
        by_line = F.flatten(F.transform(split_lines(F.col("text")), lambda x: extract_all(x, p, 1)))
        assert df.where(F.col("text").isNotNull() & ~extract_all(F.col("text"), p, 1).eqNullSafe(by_line)).count() == 0
