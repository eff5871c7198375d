"""STR-1: documents are assembled as their response chunks land.

The file source reads each stored response once.  Per document the state store
(RocksDB) keeps what has come: a map chunk number -> digest and flags, and the
bodies of documents that are not whole yet.  A chunk that comes again with the
same body is the same chunk; with another one the document is damaged.  When a
document becomes whole its bodies leave the state with it, so no folder is
listed or read again, and memory is one document's chunks.  A document whose
status changes gives a status row; the statuses over all rows are those of
``response_status``, with PROCESSED for READY.  An event-time timer of
``timeout_s`` after the first chunk turns INCOMPLETE into TIMEOUT_ERROR; chunks
that still come are taken into account.

``foreachBatch`` assembles the documents that became whole and appends results
and statuses to their stores (``sinks/store.py``) under the micro-batch's
number: at-least-once input, idempotent output.  A document that is no longer
whole loses its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.operators.assemble import assemble
from sheaf.session import materialize
from sheaf.sinks.results import read_results, write_results
from sheaf.sources.blocks import blocks_from_responses, chunk_facts, parse_responses, stored_schema

__all__ = ["assemble_batch", "document_states", "read_results", "read_status", "start_assembly_stream"]

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "_received"


@dataclass
class Chunk:
    digest: str
    damaged: bool
    failed: bool
    message: str | None
    other: bool
    ends: bool

    def plus(self, c: Chunk) -> Chunk:
        """Two deliveries of one chunk number."""
        if c.digest == self.digest:
            return self
        said = [m for m in (self.message, c.message) if m is not None]
        return Chunk(min(self.digest, c.digest), True, self.failed or c.failed, min(said) if said else None, self.other or c.other, self.ends or c.ends)


def decide(chunks: dict[int, Chunk]) -> tuple[str, str | None]:
    """(status, message) of a document, as ``response_status`` has it."""
    failed = [n for n in sorted(chunks) if chunks[n].failed]
    if failed:
        return "OCR_ENGINE_ERROR", chunks[failed[0]].message
    if any(c.damaged for c in chunks.values()):
        return "CORRUPT_RESPONSE", None
    ends = [n for n, c in chunks.items() if c.ends]
    whole = min(chunks) == 0 and len(chunks) == max(chunks) + 1 and ends == [max(chunks)] and not any(c.other for c in chunks.values())
    return ("PROCESSED" if whole else "INCOMPLETE"), None


class Documents(StatefulProcessor):
    """The state of each document; rows of ``_out`` when its status changes."""

    CHUNK = "digest string, damaged boolean, failed boolean, message string, other boolean, ends boolean"
    SAID = "status string, message string, n_chunks long"

    def __init__(self, timeout_s: float) -> None:
        self.timeout_ms = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_no int", self.CHUNK)
        self.bodies = handle.getMapState("bodies", "chunk_no int", "body string")
        self.said = handle.getValueState("said", self.SAID)

    def close(self) -> None:
        pass

    def _out(self, key, status, message, n_chunks, bodies: list[tuple[int, str]]) -> pd.DataFrame:
        rows = [(key[0], status, message, n_chunks, n, b) for n, b in bodies] or [(key[0], status, message, n_chunks, None, None)]
        out = pd.DataFrame(rows, columns=["doc_id", "status", "status_message", "n_chunks", "chunk_no", "body"])
        return out.astype({"chunk_no": "Int32", "n_chunks": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said = self.said.get()
        chunks = {int(k[0]): Chunk(*v) for k, v in self.chunks.iterator()} if said is not None else {}
        begins, changed, bodies = None, set(), {}
        for pdf in rows:
            first = int(pdf["ms"].min())
            begins = first if begins is None else min(begins, first)
            for n, digest, damaged, failed, message, other, ends, body in pdf[["chunk_no", "digest", "damaged", "failed", "message", "other", "ends", "body"]].itertuples(index=False):
                n, new = int(n), Chunk(digest, bool(damaged), bool(failed), None if pd.isna(message) else message, bool(other), bool(ends))
                if n not in chunks:
                    bodies[n] = None if pd.isna(body) else body
                else:
                    new = chunks[n].plus(new)
                if new is not chunks.get(n):
                    chunks[n] = new
                    changed.add(n)
        for n in changed:
            c = chunks[n]
            self.chunks.updateValue((n,), (c.digest, c.damaged, c.failed, c.message, c.other, c.ends))
        status, message = decide(chunks)
        if status == "INCOMPLETE" and said is not None and said[0] == "TIMEOUT_ERROR":
            status = "TIMEOUT_ERROR"  # still
        now = (status, message, len(chunks))
        if said is None:
            self.handle.registerTimer(max(begins + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1))
        elif tuple(said) == now:
            return
        open_ = said is not None and said[0] in ("INCOMPLETE", "TIMEOUT_ERROR")
        if status == "PROCESSED" and open_:
            bodies |= {int(k[0]): v[0] for k, v in self.bodies.iterator()}
        if status in ("INCOMPLETE", "TIMEOUT_ERROR"):
            for n, body in bodies.items():
                self.bodies.updateValue((n,), (body,))
        elif open_:
            self.bodies.clear()  # whole, or never to be
        self.said.update(now)
        yield self._out(key, *now, sorted(bodies.items()) if status == "PROCESSED" else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        said = self.said.get()
        if said[0] == "INCOMPLETE":
            now = ("TIMEOUT_ERROR", None, said[2])
            self.said.update(now)
            yield self._out(key, *now, [])


def document_states(stored: DataFrame, id_type: str = "long", timeout_s: float = 900, delay: str = "0 seconds") -> DataFrame:
    """Changes of documents' statuses in a stream of stored responses
    (doc_id, chunk_no, body, _received): ``(doc_id, status, status_message,
    n_chunks, chunk_no, body)``, of a whole document a row for each chunk."""
    facts = chunk_facts(parse_responses(stored.withWatermark(CLOCK, delay), ("body", CLOCK)), ("body", CLOCK))
    return (facts.withColumn("ms", F.unix_millis(CLOCK)).groupBy("doc_id")
            .transformWithStateInPandas(Documents(timeout_s), f"doc_id {id_type}, status string, status_message string, n_chunks long, chunk_no int, body string",
                                        outputMode="Update", timeMode="EventTime"))


def assemble_batch(changes: DataFrame, out_path: str, txn: str | None = None, profile: str = "current",
                   run_ts: str = "1970-01-01T00:00:00.000Z") -> None:
    """Results under ``out_path/results``, statuses under ``out_path/status``."""
    rows = materialize(changes, "stream-changes")
    if rows.isEmpty():  # a batch that only moved the watermark
        return
    states = rows.select("doc_id", "status", "status_message", "n_chunks").distinct()
    ready = states.where("status = 'PROCESSED'").select("doc_id")
    docs = assemble(blocks_from_responses(parse_responses(rows.where("status = 'PROCESSED'"))), profile=profile, run_ts=run_ts, documents=ready)
    gone = states.where("status <> 'PROCESSED'").select("doc_id", F.lit(True).alias("_deleted"))
    write_results(docs.withColumn("_deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True), f"{out_path}/results", txn=txn)
    write_results(states, f"{out_path}/status", txn=txn)


def read_status(spark: SparkSession, out_path: str) -> DataFrame:
    return read_results(spark, f"{out_path}/status")


def start_assembly_stream(spark: SparkSession, responses_path: str, out_path: str,
                          checkpoint: str, profile: str = "current",
                          max_files_per_trigger: int | None = None, available_now: bool = True,
                          id_type: str = "long", timeout_s: float = 900, clock: Column | None = None, delay: str = "0 seconds"):
    """``clock`` gives a response's event time: the micro-batch's own time
    unless given, so that no response is late; with another one (such as
    ``_metadata.file_modification_time``) rows more than ``delay`` behind the
    newest are too late and are not read."""
    reader = spark.readStream.schema(stored_schema(id_type))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    received = clock if clock is not None else F.current_timestamp()
    stream = reader.json(responses_path).select("doc_id", "chunk_no", "body", received.alias(CLOCK))

    def each(batch: DataFrame, batch_id: int) -> None:
        assemble_batch(batch, out_path, f"{checkpoint}#{batch_id}", profile)

    w = document_states(stream, id_type, timeout_s, delay).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)  # the query keeps the settings it starts with
    try:
        return w.start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
