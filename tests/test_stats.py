"""Statistics goldens: cost text, samples, word stats, totals rollup."""


from sheaf.operators import assemble as A
from sheaf.operators import stats as S
from sheaf.session import spread

SCHEMA = ("doc_id long, block_ord long, block_type string, id string, text string, "
          "confidence double, page int")


def test_cost_estimate_fixed_places(spark):
    t = spark.createDataFrame([(1, 10), (2, 3), (3, 1)], "doc_id long, pages long")
    got = {r.doc_id: (r.text_usd, r.image_usd, r.total_usd, r.total_jpy)
           for r in S.cost_estimate(t).collect()}
    assert got[1] == ("0.0150", "0.0100", "0.0250", "3.75")
    assert got[2] == ("0.0045", "0.0030", "0.0075", "1.13")   # 1.125 rounds half up
    assert got[3] == ("0.0015", "0.0010", "0.0025", "0.38")


def test_page_samples_cut_and_collapse(spark):
    text = "a\nb" + "x" * 200
    p = spark.createDataFrame([(1, 1, text), (1, 4, "late"), (2, 1, "short\ttext")],
                              "doc_id long, page_number long, text string")
    got = {(r.doc_id, r.page_number): r.sample for r in S.page_samples(p).collect()}
    assert got[(1, 1)] == ("a b" + "x" * 97) + "..."
    assert (1, 4) not in got
    sp = {(r.doc_id, r.page_number): r.sample
          for r in S.page_samples(p, chars=80, collapse="space").collect()}
    assert sp[(2, 1)] == "short text"


def test_word_stats_skips_zero_confidence(spark):
    rows = [(1, 0, "WORD", "a", "Hello", 90.0, 1), (1, 1, "WORD", "b", "world", 0.0, 1),
            (1, 2, "WORD", "c", "", 80.0, 1), (1, 3, "LINE", "d", "Hello world", 99.0, 1)]
    b = spark.createDataFrame(rows, SCHEMA)
    r = S.word_stats(b).first()
    assert (r.text, r.word_count) == ("Hello world", 1)
    assert abs(r.confidence - 0.9) < 1e-12


def test_totals_rollup_has_grand_total(spark):
    p = spark.createDataFrame([(1, 1, "ab", 1, 2), (1, 2, "c", 0, 0), (2, 1, "", 1, 0)],
                              "doc_id long, page_number long, text string, n_tables long, n_forms long")
    got = {r.doc_id: (r.pages, r.text_chars, r.tables, r.forms) for r in S.doc_totals(p).collect()}
    assert got[None] == (3, 3, 2, 2) and got[1] == (2, 3, 1, 2)


def test_preview_of_a_table_without_rows_and_first_table(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a", 0, 1), (1, 1, 2, "b", 0, 2), (1, 2, 1, "x", 1, 1), (1, 2, 2, "y", 1, 2)],
                                  "doc_id long, table_no long, cell_no long, text string, row_index int, column_index int")
    grid = A.table_grid(cells)
    got = sorted((r.table_no, r.row_no, r.row_text) for r in S.table_preview(grid, cells=cells).collect())
    assert got == [(1, 0, "2 cells (no rows structure)"), (2, 1, "x | y")]
    pages = spark.createDataFrame([(1, 1, 4, 0), (1, 2, 7, 1), (1, 3, 9, 1)], "doc_id long, page_number long, page int, n_tables long")
    page_grid = spark.createDataFrame([(1, 9, 1, 1, 1, "no")] + [(1, 7, 1, r, c, f"{r}{c}") for r in range(1, 6) for c in (1, 2)],
                                      "doc_id long, page int, table_no long, row_no long, col_no long, text string")
    got = sorted((r.page_number, r.row_no, r.row_text) for r in S.first_table(pages, page_grid).collect())
    assert got == [(2, 1, "11 | 12"), (2, 2, "21 | 22"), (2, 3, "31 | 32")]


def test_spread_only_when_too_few_splits(spark):
    one = spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).withColumnRenamed("id", "doc_id").repartition(16)
    assert spread(many).rdd.getNumPartitions() == 16


def test_pages_are_observed_by_the_write(spark):
    """Counts of processed and placeholder pages come with the action itself."""
    from sheaf.operators import stats as S
    from sheaf.sinks import results as SR
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, page_number long")
    ocr = spark.createDataFrame([(1, 1, "a b", 2, 90.0)], "doc_id long, page_number long, text string, word_count long, confidence double")
    shapes = spark.createDataFrame([], "doc_id long, page_number long, enabled boolean, shape_count int, dominant_shape string")
    seen_pages, seen = SR.observe_pages(S.page_report(pages, ocr, shapes))
    assert sorted((r["doc_id"], r["page_number"], r["processed"]) for r in seen_pages.collect()) == [(1, 1, True), (1, 2, False), (2, 1, False)]
    assert seen.get == {"pages": 3, "processed_pages": 1, "placeholder_pages": 2}


def test_run_seconds(spark):
    from sheaf.operators import metrics as M
    log = spark.createDataFrame([(1, "conversion", 2.0), (1, "conversion", 3.0), (1, "shapes", 1.0), (2, "shapes", 4.0), (None, "shapes", 9.0)],
                                "doc_id long, phase string, seconds double")
    assert sorted(tuple(r) for r in M.run_seconds(log).collect()) == [(1, 3.0, 1.0), (2, None, 4.0)]
