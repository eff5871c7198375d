"""SRC-1: object events as a stream, each with what became of its document.

An event that is delivered again (same bucket, key and version) is dropped while
the watermark remembers it.  Events then wait for their document's status in a
stream-stream left outer join: a status within ``wait`` of the event is its
answer, and once the watermark has passed that time without one the event's
status is ``NO_RESPONSE``.  Both sides' state is bounded by the watermark, and
dealt by document.  A key that cannot be decoded is a ``KEY_ERROR`` at once.

Edge cases: an event without a readable time counts as of the time of its
micro-batch; one that comes more than ``delay`` behind the newest event is too
late and is left out; a document with several statuses in that time gives a row
for each (``decided`` orders them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.plans.batch import document_id
from sheaf.sources.events import EVENT, record_columns, result_location

STATUS = "doc_id string, status string, at timestamp"


def read_event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def read_status_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Rows (doc_id, status, at): statuses with the time they were decided."""
    reader = spark.readStream.schema(STATUS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def stream_records(events: DataFrame, delay: str = "10 minutes", output_bucket: str | None = None) -> DataFrame:
    """A row per record of a stream of event messages, each once: the columns
    of ``event_records`` with ``version``, ``ts``, result location and doc_id."""
    r = events.select(F.explode("Records").alias("r"))
    o = "r.s3.object"
    version = F.coalesce(f"{o}.versionId", f"{o}.sequencer", f"{o}.eTag", F.lit(""))
    ts = F.coalesce(F.try_to_timestamp("r.eventTime"), F.current_timestamp())
    rows = r.select(*record_columns(), version.alias("version"), ts.alias("ts")).withWatermark("ts", delay)
    rows = rows.dropDuplicatesWithinWatermark(["bucket", "raw_key", "version"])
    return result_location(rows, output_bucket).withColumn("doc_id", document_id(F.col("bucket"), F.col("key")))


def event_outcomes(records: DataFrame, statuses: DataFrame, wait: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The manifest as a stream: ``(doc_id, bucket, raw_key, key, version,
    output_bucket, output_key, status, ts, decided)``."""
    said = statuses.select(F.col("doc_id").alias("_id"), F.col("status").alias("_status"), F.col("at").alias("decided")).withWatermark("decided", delay)
    within = F.expr(f"_id = doc_id AND decided >= ts AND decided <= ts + interval {wait}")
    columns = ["doc_id", "bucket", "raw_key", "key", "version", "output_bucket", "output_key"]
    joined = records.where("status = 'OK'").join(said, within, "left_outer")
    answered = joined.select(*columns, F.coalesce("_status", F.lit("NO_RESPONSE")).alias("status"), "ts", "decided")
    broken = records.where("status <> 'OK'").select(*columns, "status", "ts", F.lit(None).cast("timestamp").alias("decided"))
    return answered.unionByName(broken)


def start_manifest_stream(spark: SparkSession, events_path: str, statuses_path: str, out_path: str, checkpoint: str, wait: str = "1 hour",
                          delay: str = "10 minutes", output_bucket: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Writes the manifest rows under ``out_path``, each once (file sink)."""
    records = stream_records(read_event_stream(spark, events_path, max_files_per_trigger), delay, output_bucket)
    rows = event_outcomes(records, read_status_stream(spark, statuses_path, max_files_per_trigger), wait, delay)
    w = rows.writeStream.outputMode("append").format("json").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(out_path)


def read_manifest(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema("doc_id string, bucket string, raw_key string, key string, version string, output_bucket string, output_key string, status string, ts timestamp, decided timestamp").json(out_path)
