"""Block tables: schema, stored analysis responses (SRC-4/5), and writing
responses back as JSON chunk files.

A block table has one row per block of a document graph:
``doc_id, block_ord, block_type, id, text, confidence, page, row_index,
column_index, entity_types, relationships``.  ``block_ord`` is a total order
of blocks inside a document (response chunk, then position in the chunk).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATIONSHIP = T.StructType([
    T.StructField("Type", T.StringType()),
    T.StructField("Ids", T.ArrayType(T.StringType())),
])

RESPONSE_BLOCK = T.StructType([
    T.StructField("BlockType", T.StringType()),
    T.StructField("Id", T.StringType()),
    T.StructField("Text", T.StringType()),
    T.StructField("Confidence", T.DoubleType()),
    T.StructField("Page", T.IntegerType()),
    T.StructField("RowIndex", T.IntegerType()),
    T.StructField("ColumnIndex", T.IntegerType()),
    T.StructField("EntityTypes", T.ArrayType(T.StringType())),
    T.StructField("Relationships", T.ArrayType(RELATIONSHIP)),
])

CORRUPT = "_corrupt"
RESPONSE = T.StructType([
    T.StructField("JobStatus", T.StringType()),
    T.StructField("StatusMessage", T.StringType()),
    T.StructField("NextToken", T.StringType()),
    T.StructField("Blocks", T.ArrayType(RESPONSE_BLOCK)),
    T.StructField(CORRUPT, T.StringType()),
])

BLOCK_COLUMNS = ["doc_id", "block_ord", "block_type", "id", "text", "confidence", "page",
                 "row_index", "column_index", "entity_types", "relationships"]

# position of a block inside its chunk takes the low 32 bits of block_ord
CHUNK_SHIFT = 1 << 32


# Stored responses: JSON lines (doc_id, chunk_no, body) in folders by a hash of
# the document, so that the folders touched by a few documents are few.  The
# body is a response as it was received; a damaged one stays readable as text.
FOLDERS = 64


def stored_schema(id_type: str = "long") -> str:
    return f"doc_id {id_type}, chunk_no int, body string, part int"


def folder(doc_id, folders: int = FOLDERS):
    return F.pmod(F.xxhash64(doc_id), F.lit(folders)).cast("int")


def parse_responses(stored: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """SRC-4/5: response columns of stored rows ``(doc_id, chunk_no, body)``
    and ``digest``, which is equal for equal bodies; ``carry`` names further
    columns to keep.  A body that is no JSON
    object has its text in ``_corrupt`` and NULL elsewhere; a missing or blank
    one counts as such."""
    body = F.from_json("body", RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    return (stored.withColumn("r", body)
            .select("doc_id", "chunk_no", "r.JobStatus", "r.StatusMessage", "r.NextToken", "r.Blocks",
                    F.when(blank | F.col("r").isNull(), F.coalesce("body", F.lit("")))
                    .otherwise(F.col(f"r.{CORRUPT}")).alias(CORRUPT), F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), *carry))


def read_responses(spark: SparkSession, path: str, id_type: str = "long",
                   parts: list[int] | None = None) -> DataFrame:
    """SRC-4: stored analysis responses under ``path/part=<n>/``.  With
    ``parts`` only those folders, where they exist, are listed and read."""
    reader = spark.read.schema(stored_schema(id_type))
    if parts is None:
        return parse_responses(reader.json(path))
    try:
        return parse_responses(reader.option("basePath", path).json(f"{path}/part={{{','.join(map(str, parts))}}}"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return parse_responses(spark.createDataFrame([], stored_schema(id_type)))


def distinct_chunks(responses: DataFrame, states: DataFrame) -> DataFrame:
    """The responses of the READY documents in ``states``, one of each chunk
    that was delivered more than once.  Only documents with such chunks
    (``n_rows`` above ``n_chunks``) go through a de-duplication."""
    ready = states.where(F.col("status") == "READY").select("doc_id", (F.col("n_rows") > F.col("n_chunks")).alias("_again"))
    rows = responses.join(ready, "doc_id")
    return rows.where("not _again").unionByName(rows.where("_again").dropDuplicates(["doc_id", "chunk_no"])).drop("_again")


def blocks_from_responses(responses: DataFrame) -> DataFrame:
    """SRC-4/5: one row per block; chunks concatenated in chunk order.

    ``block_ord`` is computed, not ranked, so no shuffle is needed.
    """
    return (responses
            .select("doc_id", "chunk_no", F.posexplode("Blocks").alias("pos", "b"))
            .select(
                "doc_id",
                (F.col("chunk_no").cast("long") * CHUNK_SHIFT + F.col("pos")).alias("block_ord"),
                F.col("b.BlockType").alias("block_type"),
                F.col("b.Id").alias("id"),
                F.col("b.Text").alias("text"),
                F.col("b.Confidence").alias("confidence"),
                F.col("b.Page").alias("page"),
                F.col("b.RowIndex").alias("row_index"),
                F.col("b.ColumnIndex").alias("column_index"),
                F.col("b.EntityTypes").alias("entity_types"),
                F.transform("b.Relationships",
                            lambda r: F.struct(r["Type"].alias("type"), r["Ids"].alias("ids"))
                            ).alias("relationships")))


def chunk_facts(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """What decides a document's status, a row a delivered chunk: digest,
    damaged, failed, message, other (neither done nor failed), ends (no
    continuation token).  A missing chunk number counts as -1."""
    damaged = F.col(CORRUPT).isNotNull() | F.col("JobStatus").isNull()
    failed = F.coalesce(F.col("JobStatus") == "FAILED", F.lit(False))
    return responses.select("doc_id", F.coalesce("chunk_no", F.lit(-1)).alias("chunk_no"), "digest", damaged.alias("damaged"), failed.alias("failed"),
                            F.when(failed, F.col("StatusMessage")).alias("message"),
                            F.coalesce(F.col("JobStatus") != "SUCCEEDED", F.lit(False)).alias("other"),
                            (~damaged & F.col("NextToken").isNull()).alias("ends"), *carry)


def response_status(responses: DataFrame) -> DataFrame:
    """One status per document that has responses: ``(doc_id, status,
    status_message, n_chunks, n_rows)``.  A chunk delivered again with the same
    body is the same chunk; ``n_chunks`` counts chunk numbers, ``n_rows``
    deliveries.

    * ``OCR_ENGINE_ERROR`` - a chunk says the job failed (its message is kept);
    * ``CORRUPT_RESPONSE`` - a chunk cannot be read, has no job status, or was
      delivered with two different bodies;
    * ``INCOMPLETE`` - another job status, a chunk missing, or the only chunk
      without a continuation token is not the last;
    * ``READY`` - chunks 0..n, each ``SUCCEEDED``, the last without a token.
    """
    # dealt by document once: chunks and documents are grouped without another exchange
    slim = chunk_facts(responses).repartition("doc_id")
    each = slim.groupBy("doc_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("rows"), (F.min("digest") != F.max("digest")).alias("differs"), F.max("damaged").alias("damaged"), F.max("failed").alias("failed"),
        F.min("message").alias("message"), F.max("other").alias("other"), F.max("ends").alias("ends"))
    g = (each.groupBy("doc_id")
         .agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_chunks"), F.max(F.col("damaged") | F.col("differs")).alias("damaged"),
              F.max("failed").alias("failed"),
              F.min_by("message", F.when(F.col("failed"), F.col("chunk_no"))).alias("message"),
              F.max("other").alias("other"),
              F.min("chunk_no").alias("low"), F.max("chunk_no").alias("high"),
              F.count_if(F.col("ends")).alias("n_ends"), F.max(F.when(F.col("ends"), F.col("chunk_no"))).alias("end")))
    whole = (~F.col("other") & (F.col("low") == 0) & (F.col("n_chunks") == F.col("high") + 1)
             & (F.col("n_ends") == 1) & (F.col("end") == F.col("high")))
    status = (F.when(F.col("failed"), "OCR_ENGINE_ERROR").when(F.col("damaged"), "CORRUPT_RESPONSE")
              .when(F.coalesce(whole, F.lit(False)), "READY").otherwise("INCOMPLETE"))
    return g.select("doc_id", status.alias("status"),
                    F.when(F.col("failed"), F.col("message")).alias("status_message"), "n_chunks", "n_rows")


def to_responses(blocks: DataFrame, chunk_span: int = 2_000_000,
                 status: str = "SUCCEEDED") -> DataFrame:
    """Split each document's blocks into responses shaped like the analysis
    service output: chunk = ``block_ord // chunk_span``, a monotonic map, so
    reading the chunks back in chunk order keeps the block order."""
    blk = F.struct(
        F.col("block_type").alias("BlockType"), F.col("id").alias("Id"),
        F.col("text").alias("Text"), F.col("confidence").alias("Confidence"),
        F.col("page").alias("Page"), F.col("row_index").alias("RowIndex"),
        F.col("column_index").alias("ColumnIndex"), F.col("entity_types").alias("EntityTypes"),
        F.transform("relationships",
                    lambda r: F.struct(r["type"].alias("Type"), r["ids"].alias("Ids"))
                    ).alias("Relationships"))
    chunks = (blocks
              .withColumn("chunk_no", F.floor(F.col("block_ord") / chunk_span).cast("int"))
              .groupBy("doc_id", "chunk_no")
              # ordered by block_ord; a chunk is one document's share, bounded
              .agg(F.sort_array(F.collect_list(F.struct("block_ord", blk.alias("b")))).alias("bs")))
    last = chunks.groupBy("doc_id").agg(F.max("chunk_no").alias("last_chunk"))
    return (chunks.join(last, "doc_id")
            .select("doc_id", "chunk_no",
                    F.lit(status).alias("JobStatus"),
                    F.lit(None).cast("string").alias("StatusMessage"),
                    # a continuation token on every chunk but the last
                    F.when(F.col("chunk_no") < F.col("last_chunk"),
                           F.concat(F.lit("page-"), (F.col("chunk_no") + 1).cast("string")))
                    .alias("NextToken"),
                    F.transform("bs", lambda x: x["b"]).alias("Blocks")))


def stored(responses: DataFrame, folders: int = FOLDERS) -> DataFrame:
    """Responses as they are stored: ``(doc_id, chunk_no, body, part)``."""
    body = F.struct("JobStatus", "StatusMessage", "NextToken", "Blocks")
    return responses.select("doc_id", "chunk_no", F.to_json(body, {"ignoreNullFields": "true"}).alias("body"),
                            folder(F.col("doc_id"), folders).alias("part"))


def write_responses(responses: DataFrame, path: str, mode: str = "overwrite", files: int = 8) -> None:
    """``files`` files a folder at most, written by as many tasks."""
    spread = F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(files))
    stored(responses).repartition("part", spread).write.mode(mode).partitionBy("part").json(path)
