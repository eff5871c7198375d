"""SNK-1: a versioned store of per-document results.

    path/data/run=<id>/...        rows of one run, JSON lines, never changed
    path/commits/epoch=<n>/...    one row: which run is epoch n, and its schema

A run writes only its own documents into a folder of its own and commits by its
marker, written last; until then no reader sees it, and a run that was killed
leaves a folder that nothing refers to.  No run reads or rewrites documents of
others.  Of a document the row of the latest committed epoch counts; a row can
also say that the document has no result any more.  ``compact`` merges the
epochs so far into one, as a new epoch that replaces all before it, and leaves
their folders where they are (``obsolete`` lists them), so readers that are
under way keep their files.

One writer at a time commits (a stream's driver, a batch job).  ``txn`` names a
unit of work, such as a micro-batch: a second commit of the same one is left
out, which makes at-least-once input idempotent.

Edge cases: an empty run commits an epoch without rows; of a document that a run
carries twice the greatest row by its JSON text counts; rows with a null id are
one document; a store without commits has no rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 100_000

COMMIT = "epoch long, run string, txn string, replaces boolean, n_rows long, row_schema string"
_OWN = T.StructType([T.StructField("_deleted", T.BooleanType()), T.StructField("_epoch", T.LongType())])


@dataclass(frozen=True)
class Commit:
    epoch: int
    run: str
    txn: str | None
    replaces: bool     # all epochs before it
    n_rows: int
    schema: T.StructType


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """Committed epochs in order, a row a run: read from the marker folder."""
    try:
        rows = spark.read.schema(COMMIT).json(f"{path}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((Commit(r["epoch"], r["run"], r["txn"], r["replaces"], r["n_rows"], T.StructType.fromJson(json.loads(r["row_schema"])))
                   for r in rows), key=lambda c: c.epoch)


def _live(found: list[Commit]) -> list[Commit]:
    """The last replacing epoch, if there is one, and those after it."""
    base = max((c.epoch for c in found if c.replaces), default=-1)
    return [c for c in found if c.epoch >= base]


def _commit(spark: SparkSession, path: str, c: Commit) -> None:
    row = [(c.epoch, c.run, c.txn, c.replaces, c.n_rows, c.schema.json())]
    (spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("errorifexists").json(f"{path}/commits/epoch={c.epoch}"))


def write_run(docs: DataFrame, path: str, epoch: int, files: int | None = None) -> str:
    """The rows of ``docs`` (doc_id, ..., perhaps _deleted) as a run of the
    given epoch, not committed; its name."""
    run = uuid.uuid4().hex
    docs = docs.drop(*[f.name for f in docs.schema.fields if isinstance(f.dataType, T.NullType)])
    if "_deleted" not in docs.columns:
        docs = docs.withColumn("_deleted", F.lit(False))
    rows = docs.withColumn("_epoch", F.lit(epoch).cast("long"))
    if files:
        rows = rows.repartition(files, "doc_id")
    rows.write.mode("errorifexists").option("ignoreNullFields", "true").json(f"{path}/data/run={run}")
    return run


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name not in ("_deleted", "_epoch") and not isinstance(f.dataType, T.NullType)])


def append(docs: DataFrame, path: str, txn: str | None = None, files: int | None = None) -> int:
    """Writes and commits the rows of ``docs`` as the next epoch; its number.
    Where ``_deleted`` is true the document has no result from then on.  A
    ``txn`` that is already committed is not written again."""
    spark = docs.sparkSession
    found = commits(spark, path)
    for c in found:
        if txn is not None and c.txn == txn:
            return c.epoch
    epoch = max((c.epoch for c in found), default=-1) + 1
    run = write_run(docs, path, epoch, files)
    n = spark.read.schema("_epoch long").json(f"{path}/data/run={run}").count()
    _commit(spark, path, Commit(epoch, run, txn, False, n, _schema(docs)))
    return epoch


def latest(spark: SparkSession, path: str, schema: T.StructType | str | None = None, with_deleted: bool = False) -> DataFrame:
    """The current row of each document.  Rows of epochs since the last
    replacing one decide by their ids; the replaced epoch's rows, which are
    most, only lose those ids, a small side that AQE broadcasts once its
    measured size allows it, so they are not shuffled then."""
    live = _live(commits(spark, path))
    own = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    own = own or (live[-1].schema if live else T.StructType([T.StructField("doc_id", T.LongType())]))
    own = T.StructType([f for f in own.fields if f.name not in ("_deleted", "_epoch")])
    whole = T.StructType(own.fields + _OWN.fields)

    def rows(some: list[Commit]) -> DataFrame:
        if not some:
            return spark.createDataFrame([], whole)
        return spark.read.schema(whole).json([f"{path}/data/run={c.run}" for c in some])

    base, delta = [c for c in live if c.replaces], [c for c in live if not c.replaces]
    new = rows(delta)
    last = new.groupBy("doc_id").agg(F.max("_epoch").alias("_last")).withColumnRenamed("doc_id", "_id")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    # a run may carry a document twice: the greatest text counts
    body = F.struct(*own.names, "_deleted")
    out = (new.join(last, same & (F.col("_epoch") == F.col("_last")), "left_semi")
           .groupBy("doc_id", "_epoch").agg(F.max_by(body, F.struct("_deleted", F.to_json(body))).alias("_row")).select("_row.*", "_epoch"))
    if base:
        out = rows(base).join(last, same, "left_anti").unionByName(out)
    if with_deleted:
        return out
    return out.where("not _deleted").select(*own.names)


def compact(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Merges all committed epochs into a new one that replaces them; the
    number of its files follows its rows.  The number of the epoch."""
    found = commits(spark, path)
    if not found:
        raise ValueError("nothing to compact")
    from sheaf.session import materialize
    rows = materialize(latest(spark, path), "store-compact")
    n = rows.count()
    epoch = found[-1].epoch + 1
    run = write_run(rows, path, epoch, max(1, -(-n // rows_per_file)))
    _commit(spark, path, Commit(epoch, run, None, True, n, found[-1].schema))
    return epoch


def obsolete(spark: SparkSession, path: str) -> list[str]:
    """Folders of runs that no reader opens any more."""
    found = commits(spark, path)
    live = {c.run for c in _live(found)}
    return [f"{path}/data/run={c.run}" for c in found if c.run not in live]
