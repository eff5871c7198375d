"""AGG-9 by signed deltas: stream = batch = from scratch."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from sheaf.operators.stats import doc_totals
from sheaf.streaming import totals as T

DELIVERY = "doc_id long, seq long, _deleted boolean, pages long, text_chars long, tables long, forms long"


def deliveries(n_batches=5, n_docs=30):
    """Batches of documents, many of them delivered again, some deleted, some
    late (a smaller seq), repeated, without an id or with nulls."""
    rnd = random.Random(4)
    out = []
    for b in range(n_batches):
        rows = []
        for d in rnd.sample(range(n_docs), n_docs // 2):
            row = (d, 10 * b + rnd.randrange(3), rnd.random() < 0.1, rnd.randrange(1, 9), rnd.randrange(900), rnd.choice([None, 0, 3]), rnd.randrange(3))
            rows += [row, row] if rnd.random() < 0.2 else [row]
            if b and rnd.random() < 0.3:
                rows.append((d, 10 * (b - 1) - 5, False, 50, 50, 50, 50))
        out.append(rows + [(None, b, False, 1, 1, 1, 1)])
    return out


def scratch(rows):
    """{doc_id: measures} of the documents that are there at the end."""
    last = {}
    for d, seq, gone, *m in rows:
        if d is not None:
            c = (seq, not gone, *(0 if gone else x or 0 for x in m))
            last[d] = max(last.get(d, c), c)
    return {d: c[2:] for d, c in last.items() if c[1]}


def test_totals_after_five_micro_batches_equal_totals_from_scratch(spark):
    base = tempfile.mkdtemp(prefix="sheaf-totals-")
    inbox, out, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    seen = []
    for rows in deliveries():
        seen += rows
        spark.createDataFrame(rows, DELIVERY).coalesce(1).write.mode("append").json(inbox)
        T.start_totals_stream(spark.readStream.schema(DELIVERY).json(inbox), out, ckpt).awaitTermination()
        got = {r.doc_id: tuple(r[m] for m in T.MEASURES) for r in T.read_totals(spark, out).collect()}
        want = scratch(seen)
        assert got.pop(None) == tuple(map(sum, zip(*want.values())))
        assert got == want
    # the same by doc_totals over pages: a page row for each page, measures on the first
    pages = spark.createDataFrame([(d, "x" * m[1] if p == 0 else "", m[2] if p == 0 else 0, m[3] if p == 0 else 0) for d, m in want.items() for p in range(m[0])],
                                  "doc_id long, text string, n_tables long, n_forms long")
    assert {tuple(r) for r in doc_totals(pages).collect()} == {(r.doc_id, *(r[m] for m in T.MEASURES)) for r in T.read_totals(spark, out).collect()}
    # a batch that is run again adds nothing
    again = spark.createDataFrame([(1, 99, *range(10))], f"doc_id long, {T.Contribution.LAST}, " + ", ".join(f"d_{p} long" for p in T.PARTS))
    before = sorted(T.read_totals(spark, out).collect(), key=str)
    T.add_batch(again, out, f"{ckpt}#0", 0)
    assert sorted(T.read_totals(spark, out).collect(), key=str) == before


def test_running_totals_equal_totals_from_scratch_at_every_seq(spark):
    rows = [r for b in deliveries() for r in b]
    deltas = T.signed_deltas(spark.createDataFrame(rows, DELIVERY))
    got = {r.seq: tuple(r)[1:] for r in T.totals_by_seq(deltas).collect()}
    for seq, found in got.items():
        want = scratch([r for r in rows if r[1] <= seq])
        assert found == (len(want), *(map(sum, zip(*want.values())) if want else [0] * len(T.MEASURES)))
    assert set(got) == {r[1] for r in rows if r[0] is not None}


def test_no_deliveries(spark):
    assert T.totals_by_seq(T.signed_deltas(spark.createDataFrame([], DELIVERY).drop("_deleted"))).collect() == []
    assert T.read_totals(spark, os.path.join(tempfile.mkdtemp(), "none")).where(F.col("doc_id").isNotNull()).collect() == []
