"""Object-created events (SRC-1, SRC-2) and result locations (SNK-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S3_OBJECT = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("eTag", T.StringType()), T.StructField("sequencer", T.StringType()),
    T.StructField("versionId", T.StringType())])
S3_BUCKET = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ownerIdentity", T.StructType([T.StructField("principalId", T.StringType())])),
    T.StructField("arn", T.StringType())])
RECORD = T.StructType([
    T.StructField("eventVersion", T.StringType()), T.StructField("eventSource", T.StringType()),
    T.StructField("awsRegion", T.StringType()), T.StructField("eventTime", T.StringType()),
    T.StructField("eventName", T.StringType()),
    T.StructField("s3", T.StructType([
        T.StructField("s3SchemaVersion", T.StringType()),
        T.StructField("configurationId", T.StringType()),
        T.StructField("bucket", S3_BUCKET), T.StructField("object", S3_OBJECT)]))])
EVENT = T.StructType([T.StructField("Records", T.ArrayType(RECORD))])

# records per derived event message
RECORDS_PER_EVENT = 10


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def event_records(events: DataFrame) -> DataFrame:
    """SRC-1/SRC-2: one row per record, key decoded (``+`` is a space, then
    percent-decoding); a malformed key decodes to NULL and gets status
    ``KEY_ERROR`` instead of aborting the batch."""
    r = events.select(F.monotonically_increasing_id().alias("event_no"), F.posexplode("Records").alias("record_no", "r"))
    return r.select("event_no", "record_no", *record_columns())


def record_columns() -> list[Column]:
    """The columns of a record ``r``, in a batch or a stream."""
    raw = F.col("r.s3.object.key")
    key = F.try_url_decode(F.regexp_replace(raw, r"\+", " "))
    return [
        F.col("r.s3.bucket.name").alias("bucket"),
        raw.alias("raw_key"),
        key.alias("key"),
        F.coalesce(F.col("r.s3.object.size"), F.lit(0)).cast("long").alias("size"),
        F.col("r.eventName").alias("event_name"),
        F.col("r.eventTime").alias("event_time"),
        F.when(key.isNull(), F.lit("KEY_ERROR")).otherwise(F.lit("OK")).alias("status")]


# FIXED VALUES: folder and suffix of result keys (in result_location)
def result_location(records: DataFrame, output_bucket: str | None = None) -> DataFrame:
    """SNK-2: ``output_bucket`` (parameter, else the input bucket) and
    ``processed/<key without its last extension>-result.json``."""
    return records.select(
        "*",
        F.coalesce(F.lit(output_bucket), F.col("bucket")).alias("output_bucket"),
        F.concat(F.lit("processed/"), F.regexp_replace("key", r"\.[^/.]+\z", ""),
                 F.lit("-result.json")).alias("output_key"))


def document_events(documents: DataFrame) -> DataFrame:
    """D5: event messages derived from ``documents`` (bucket = source, an
    encoded key per document, size = n_chars), ``RECORDS_PER_EVENT`` records
    per message."""
    rec = F.struct(
        F.lit("2.1").alias("eventVersion"), F.lit("aws:s3").alias("eventSource"),
        F.lit("us-east-1").alias("awsRegion"), F.lit("2024-01-01T00:00:00.000Z").alias("eventTime"),
        F.lit("ObjectCreated:Put").alias("eventName"),
        F.struct(F.lit("1.0").alias("s3SchemaVersion"), F.lit("cfg").alias("configurationId"),
                 F.struct(F.col("source").alias("name"),
                          F.struct(F.lit("owner").alias("principalId")).alias("ownerIdentity"),
                          F.concat(F.lit("arn:aws:s3:::"), F.col("source")).alias("arn"))
                 .alias("bucket"),
                 F.struct(F.concat(F.lit("in+put/"), F.col("lang"), F.lit("%2F"),
                                   F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("key"),
                          F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("eTag"),
                          F.lit(None).cast("string").alias("sequencer")).alias("object"))
        .alias("s3"))
    return (documents
            .groupBy("source", F.floor(F.col("doc_id") / RECORDS_PER_EVENT).alias("batch"))
            .agg(F.array_sort(F.collect_list(F.struct("doc_id", rec.alias("r")))).alias("rs"))
            .select(F.transform("rs", lambda x: x["r"]).alias("Records")))
