"""Structured log lines as a source (SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("requestId", T.StringType()), T.StructField("message", T.StringType()),
    # free-form payload kept as its JSON text
    T.StructField("data", T.StringType()), T.StructField("environment", T.StringType()),
])


def parse_logs(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON log lines (one record per line) -> typed log rows; a line that
    does not parse yields NULL fields instead of failing the job."""
    return (lines.select(F.from_json(col, LOG).alias("r")).select("r.*")
            .withColumn("ts", F.to_timestamp("timestamp")))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def event_log_lines(events: DataFrame) -> DataFrame:
    """Log lines as the service writes them, derived from ``events``."""
    is_err = F.col("event_type") == "error"
    rec = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(is_err, "ERROR").otherwise("INFO").alias("level"),
        F.lit("ocr-service").alias("service"), F.lit("1.0.0").alias("version"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("requestId"),
        F.when(is_err, "S3 OCR processing failed").otherwise("Processing completed").alias("message"),
        F.to_json(F.struct(F.col("user_id").alias("key"))).alias("data"),
        F.lit("production").alias("environment"))
    return events.select(F.to_json(rec).alias("value"))


def log_errors(logs: DataFrame) -> DataFrame:
    """Error lines per message and hour (hour as ``yyyy-MM-dd HH:00``)."""
    return (logs.filter(F.upper("level") == "ERROR")
            .groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00").alias("hour"),
                     "message")
            .agg(F.count(F.lit(1)).alias("n")))
