"""AGG-9 kept up to date: corpus totals that follow each delivered document.

A delivery is one document's measures, ``(doc_id, seq, _deleted, pages,
text_chars, tables, forms)``.  The state store keeps the last contribution of
each document, so a document that is delivered again subtracts it and adds the
new one: a signed delta.  Corpus totals are the sum of all deltas; no document
but the delivered ones is looked up.

Edge cases: of a document's deliveries the greatest ``seq`` counts, of equal
ones the greatest row; one that comes after a greater ``seq`` changes nothing;
null measures count as 0; a deleted document contributes nothing; rows without
a doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.session import materialize
from sheaf.sinks import store
from sheaf.streaming.assembly import PROVIDER

MEASURES = ("pages", "text_chars", "tables", "forms")
PARTS = ("documents", *MEASURES)  # what a document contributes


def contributions(deliveries: DataFrame) -> DataFrame:
    """(doc_id, seq, documents, pages, ...): what each delivery stands for."""
    live = ~F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in deliveries.columns else F.lit(True)
    parts = [F.when(live, F.coalesce(F.col(m), F.lit(0))).otherwise(0).cast("long").alias(m) for m in MEASURES]
    return deliveries.where("doc_id is not null").select("doc_id", F.col("seq").cast("long").alias("seq"), live.cast("long").alias("documents"), *parts)


def signed_deltas(deliveries: DataFrame) -> DataFrame:
    """The batch form: each document's changes in order of ``seq``."""
    rows = contributions(deliveries).groupBy("doc_id", "seq").agg(F.max(F.struct(*PARTS)).alias("c")).select("doc_id", "seq", "c.*")
    w = Window.partitionBy("doc_id").orderBy("seq")
    return rows.select("doc_id", "seq", *[(F.col(p) - F.lag(p, 1, 0).over(w)).alias(p) for p in PARTS])


def totals_by_seq(deltas: DataFrame) -> DataFrame:
    """Corpus totals after each ``seq``: running sums of a row a ``seq``."""
    sums = deltas.groupBy("seq").agg(*[F.sum(p).alias(p) for p in PARTS])
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("seq", *[F.sum(p).over(w).alias(p) for p in PARTS])


class Contribution(StatefulProcessor):
    """The last contribution of each document; a row where it changes."""

    LAST = "seq long, " + ", ".join(f"{p} long" for p in PARTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.LAST)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()
        before = None if before is None else tuple(int(x) for x in before)
        now = before
        for pdf in rows:
            new = max(map(tuple, pdf[["seq", *PARTS]].astype("int64").to_numpy().tolist()))
            now = new if now is None else max(now, new)
        if now == before:
            return
        self.last.update(now)
        old = before[1:] if before else (0,) * len(PARTS)
        yield pd.DataFrame([(key[0], *now, *(x - y for x, y in zip(now[1:], old)))], columns=["doc_id", "seq", *PARTS, *[f"d_{p}" for p in PARTS]])


def document_deltas(deliveries: DataFrame, id_type: str = "long") -> DataFrame:
    """A stream of ``(doc_id, seq, documents, pages, ..., d_documents, d_pages,
    ...)``: new contributions with their change."""
    out = f"doc_id {id_type}, {Contribution.LAST}, " + ", ".join(f"d_{p} long" for p in PARTS)
    return contributions(deliveries).groupBy("doc_id").transformWithStateInPandas(Contribution(), out, outputMode="Update", timeMode="None")


def add_batch(changes: DataFrame, out_path: str, txn: str, batch_id: int) -> None:
    """The documents' contributions under ``out_path/documents`` and the sum of
    the batch's deltas, one row, under ``out_path/deltas``.  Both know the
    batch by ``txn``, so one that is run again after a crash adds nothing twice."""
    rows = materialize(changes, "totals-changes")
    if rows.isEmpty():
        return
    store.append(rows.select("doc_id", *MEASURES, (F.col("documents") == 0).alias("_deleted")), f"{out_path}/documents", txn=txn)
    sums = rows.agg(*[F.sum(f"d_{p}").alias(p) for p in PARTS]).withColumn("doc_id", F.lit(batch_id).cast("long"))
    store.append(sums, f"{out_path}/deltas", txn=txn, files=1)


def read_totals(spark: SparkSession, out_path: str, id_type: str = "long") -> DataFrame:
    """Per document and, with a null doc_id, of the corpus: the columns of
    ``doc_totals``.  The corpus row is the sum of the batches' deltas."""
    kinds = ", ".join(f"{m} long" for m in MEASURES)
    docs = store.latest(spark, f"{out_path}/documents", f"doc_id {id_type}, {kinds}")
    deltas = store.latest(spark, f"{out_path}/deltas", f"doc_id long, {kinds}")
    whole = deltas.agg(*[F.sum(m).alias(m) for m in MEASURES]).withColumn("doc_id", F.lit(None).cast(id_type))
    return docs.unionByName(whole)


def start_totals_stream(deliveries: DataFrame, out_path: str, checkpoint: str, id_type: str = "long", available_now: bool = True):
    """Totals under ``out_path`` from a stream of deliveries."""
    spark = deliveries.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, out_path, f"{checkpoint}#{batch_id}", batch_id)

    w = document_deltas(deliveries, id_type).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)  # the query keeps the settings it starts with
    try:
        return w.start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
