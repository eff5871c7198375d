"""E1 as one batch job: object events -> stored responses -> results.

``run_batch`` is the Spark counterpart of an event handler:
records are decoded (SRC-1/2), each record names a document whose stored
analysis responses have the id ``document_id(bucket, key)``.  Documents whose
responses are all there are assembled with the record's key and size in the
envelope (PRJ-5) and written idempotently (SNK-1); the manifest says where
each result belongs (SNK-2) and why a record produced none: a damaged,
failed or unfinished response never counts as processed, and a response
without blocks gives a result with 0 pages.  Of records that repeat a key
the last one gives the envelope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.assemble import assemble
from sheaf.sinks.results import write_results
from sheaf.session import materialize
from sheaf.sources.blocks import blocks_from_responses, distinct_chunks, folder, read_responses, response_status
from sheaf.sources.events import event_records, result_location


def document_id(bucket, key):
    """Identity of an object: SHA-256 of its bucket and key, as text."""
    return F.sha2(F.concat(bucket, F.lit("/"), key), 256)


def run_batch(spark: SparkSession, events: DataFrame, responses_path: str, out_path: str,
              output_bucket: str | None = None, profile: str = "current",
              run_ts: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Returns the manifest ``(doc_id, bucket, raw_key, key, output_bucket,
    output_key, status)``; results are written under ``out_path``."""
    recs = (result_location(event_records(events), output_bucket)
            .withColumn("doc_id", document_id(F.col("bucket"), F.col("key"))))
    ok = recs.filter(F.col("status") == "OK")
    # the folders that the records fall into: at most FOLDERS numbers
    parts = sorted(r["p"] for r in ok.select(folder(F.col("doc_id")).alias("p")).distinct().collect())
    chunks = (read_responses(spark, responses_path, "string", parts)
              .join(ok.select("doc_id").distinct(), "doc_id", "left_semi"))
    # decided once: results and manifest follow the same reading of the folder
    states = materialize(response_status(chunks), "response-status")
    ready = states.filter(F.col("status") == "READY").select("doc_id")
    blocks = blocks_from_responses(distinct_chunks(chunks, states))
    files = (ok.groupBy("doc_id")
             .agg(F.max_by(F.struct(F.col("key").alias("input_file"), F.col("size").alias("file_size")),
                           F.struct("event_no", "record_no")).alias("f"))
             .select("doc_id", "f.input_file", "f.file_size", F.lit(0).cast("long").alias("processing_ms")))
    docs = assemble(blocks, files=files, profile=profile, run_ts=run_ts, documents=ready)
    # a document that had a result and is not whole any more loses it
    gone = states.where(F.col("status") != "READY").select("doc_id", F.lit(True).alias("_deleted"))
    write_results(docs.withColumn("_deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True), out_path)
    return (recs.join(states.withColumnRenamed("status", "response"), "doc_id", "left")
            .select("doc_id", "bucket", "raw_key", "key", "output_bucket", "output_key",
                    F.when(F.col("status") != "OK", F.col("status"))
                    .when(F.col("response").isNull(), F.lit("NO_RESPONSE"))
                    .when(F.col("response") == "READY", F.lit("PROCESSED"))
                    .otherwise(F.col("response")).alias("status")))
