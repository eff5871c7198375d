"""Context-aware extraction goldens (TXT-24)."""

import pytest

from sheaf.operators import drawing as DR

GOLDEN = [
    ("Drawing\nKA21941-A004002\n110-510",
     ["KA21941-A004002", "KA-21941", "KA21-941", "A-004002", "A004-002", "110-510"]),
    ("Drawing Number: KA21941-A004002",
     ["umber", "KA21941-A004002", "KA-21941", "KA21-941", "A-004002", "A004-002"]),
    ("DWG\nAB12CD34", ["AB-12CD34", "AB12-CD34"]),
    ("図面 7005_0040", []),
    ("see 110-510 drawing", ["110-510"]),
]


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_context_golden(spark, i):
    text, expected = GOLDEN[i]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.value for r in sorted(DR.drawing_numbers(df).collect(), key=lambda r: r.seq)]
    assert got == expected


def test_fuzzy_detector_is_linear(spark):
    # a long line with many d/r/a letters but no full subsequence must not
    # backtrack (the naive d.*r.*a.*w.*i.*n.*g form takes seconds here)
    import time
    line = "dra" * 3000
    df = spark.createDataFrame([(1, line + "\nAB12-CD34")], "doc_id long, text string")
    t = time.time()
    assert DR.drawing_numbers(df).count() == 0
    assert time.time() - t < 30
