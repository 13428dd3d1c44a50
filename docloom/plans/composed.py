"""Ingestion in one call, for a whole table or batch by batch, that resumes where it stopped.

Each stage writes its rows once, under ``<base>/<stage>/batch=<id>``. A ledger says which are done:
a run that is repeated after a failure reads those and goes on with the first that is not, so a
replayed batch changes nothing. A chunk's content is stored by the stage that cuts it and, behind
title and summary, by ``enrich``; the others hold its place and hash. What earlier batches stored (document hashes, chunk owners and how
their embedding went) is read back from the same folders.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chunking as ck
from ..functions.embedding import Embedder
from ..functions.numbers import content_hash
from ..operators.dedup import dedup_chunks, dedupe
from ..sources.tables import exists
from .ingest import chunk_records, embed_chunks, enrich, gate, link, reconcile
from .upkeep import MAX_TRIES

ENTRY = "stage string, action string, at double, error string, schema string"
#: Bytes of a row group, the least that a task reads, so that also a small batch is shared out to all cores.
ROW_GROUP = 8 << 20
#: Where a chunk stands, and its hash.
PLACE = ["document_id", "chunk_index", "chunk_hash"]
#: What the next batches need of the earlier ones.
INTAKE = "document_id {key}, project_id string, content_hash string, action string, stored_id {key}"
CHUNKS = "chunk_hash string, document_id {key}, embed_status string"


class Ledger:
    """Stages of one batch under ``base``: each is built and written once, and read from then on.

    A stage is done when its entry is written, after its rows were committed; if a run dies between
    the two, the rows are written again. After MAX_TRIES failures a stage is not tried again.
    """

    def __init__(self, spark: SparkSession, base: str, batch_id: int):
        self.spark, self.base, self.batch_id = spark, base, batch_id
        self.log = f"{base}/_ledger/batch={batch_id}"
        self.entries = [r.asDict() for r in self.history().collect()]

    def history(self) -> DataFrame:
        """stage, action (completed/failed), at, error and schema, of this batch."""
        if not exists(self.spark, self.log):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(self.log)

    def path(self, stage: str) -> str:
        return f"{self.base}/{stage}/batch={self.batch_id}"

    def note(self, stage: str, action: str, error: str | None = None, schema: T.StructType | None = None) -> None:
        entry = {"stage": stage, "action": action, "at": time.time(), "error": error, "schema": schema and schema.json()}
        self.spark.createDataFrame([tuple(entry.values())], ENTRY).coalesce(1).write.mode("append").json(self.log)
        self.entries.append(entry)

    def done(self, stage: str) -> T.StructType | None:
        """The schema of a stage that is done."""
        found = [e["schema"] for e in self.entries if e["stage"] == stage and e["action"] == "completed"]
        return T.StructType.fromJson(json.loads(found[0])) if found else None

    def run(self, stage: str, build: Callable[[], DataFrame]) -> DataFrame:
        schema = self.done(stage)
        if schema is None:
            tries = sum(e["stage"] == stage and e["action"] == "failed" for e in self.entries)
            if tries >= MAX_TRIES:
                raise RuntimeError(f"stage {stage} of batch {self.batch_id} failed {tries} times")
            try:
                rows = build()
                schema = rows.schema
                written = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
                written.parquet(self.path(stage))
            except Exception as error:
                self.note(stage, "failed", str(error)[:1000])
                raise
            self.note(stage, "completed", schema=schema)
        return self.spark.read.schema(schema).parquet(self.path(stage))

    def earlier(self, stage: str, schema: str) -> DataFrame:
        """Rows that the batches before this one wrote in a stage."""
        folder = f"{self.base}/{stage}"
        if not self.batch_id or not exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch int").parquet(folder)
        return rows.filter(F.col("batch") < self.batch_id).drop("batch")


def intake(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents with content_hash, ``action`` (create/cached) and stored_id.

    Per project the first document of a content, by document_id, is created and the rest are cached;
    a content that an earlier batch stored is cached altogether. A null text is empty.
    """
    key = ["project_id", "content_hash"]
    rows = docs.withColumn("content_hash", content_hash(F.coalesce("text", F.lit(""))))
    known = stored.filter("action = 'create'").select(*key, F.col("document_id").alias("_stored"))
    first = rows.groupBy(*key).agg(F.min("document_id").alias("_first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    first = first.alias("a").join(known.alias("b"), same, "left").select("a.*", "_stored")
    judged = rows.alias("a").join(first.alias("b"), same, "left").select("a.*", "_first", "_stored")
    fresh = F.col("_stored").isNull() & (F.col("document_id") == F.col("_first"))
    return judged.select(
        *docs.columns, "content_hash", F.when(fresh, "create").otherwise("cached").alias("action"),
        F.coalesce("_stored", "_first").alias("stored_id"),
    )


def ingest_batch(
    docs: DataFrame, base: str, batch_id: int = 0, chunks: Callable[[Column], Column] | None = None, fn: Embedder | None = None
) -> DataFrame:
    """Take in, gate, chunk, dedup, enrich, embed, link and reconcile; the verdict of each document.

    ``docs``: document_id, project_id, file_name, text, file_size, with document ids that no batch
    repeats. ``chunks`` cuts a text into an array, by default into slices of 512 characters.
    ``outcome`` is that of ``reconcile_counts``, QUARANTINED for a text that the gate refuses, or
    CACHED for one that is stored already. Calling it again with the same ``base`` and ``batch_id``
    resumes, or returns the verdicts as they are.
    """
    book = Ledger(docs.sparkSession, base, batch_id)
    cut = chunks or (lambda text: ck.fixed(text, 512))
    kind = docs.schema["document_id"].dataType.simpleString()
    known = lambda: book.earlier("embed", CHUNKS.format(key=kind))
    columns = ["document_id", "project_id", "file_name", "text", "file_size"]

    taken = book.run("intake", lambda: intake(docs.select(*columns), book.earlier("intake", INTAKE.format(key=kind))))
    gated = book.run("gate", lambda: gate(taken.filter("action = 'create'").select(*columns)))
    pieces = book.run("chunk", lambda: chunk_records(gated, F.when(F.col("is_acceptable"), cut(F.col("text")))))
    owned = book.run("dedup", lambda: dedup_chunks(pieces.select(*PLACE), known().select("chunk_hash", "document_id")))

    def enriched_chunks() -> DataFrame:
        fresh = dedupe(owned.filter("is_new").select(*PLACE), "chunk_hash", ["chunk_index"])
        # the enriched text ends with the content, which is kept only where there is none
        missing = F.coalesce("enriched_content", F.lit("")) == ""
        return enrich(fresh, gated, pieces).withColumn("content", F.when(missing, F.col("content")))

    rich = book.run("enrich", enriched_chunks)
    embedded = book.run("embed", lambda: embed_chunks(rich, fn).drop("content", "enriched_content"))
    links = book.run("link", lambda: link(owned, docs.sparkSession.createDataFrame([], f"document_id {kind}, chunk_id string")))

    def verdict() -> DataFrame:
        status = embedded.select("chunk_hash", "embed_status").unionByName(known().select("chunk_hash", "embed_status"))
        judged = reconcile(owned, links, status).select("document_id", "expected", "links", "embedded", "failed", "outcome")
        heads = taken.select("document_id", "project_id", "action", "stored_id")
        heads = heads.join(gated.select("document_id", "is_acceptable", "quality_score"), "document_id", "left")
        outcome = (
            F.when(F.col("action") == "cached", "CACHED").when(~F.col("is_acceptable"), "QUARANTINED")
            .otherwise(F.coalesce("outcome", F.lit("READY")))
        )
        counts = ["expected", "links", "embedded", "failed"]
        return heads.join(judged, "document_id", "left").withColumn("outcome", outcome).fillna(0, counts)

    return book.run("verdict", verdict)


def ingest_stream(
    stream: DataFrame, base: str, checkpoint: str, chunks: Callable[[Column], Column] | None = None, fn: Embedder | None = None
):
    """Start incremental ingestion: every micro-batch runs all stages against what is stored.

    A batch that is repeated after a failure resumes from its ledger, so each document is stored once.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, base, batch_id, chunks, fn)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts(spark: SparkSession, base: str, kind: str = "long") -> DataFrame:
    """Verdicts of all batches."""
    schema = (
        f"document_id {kind}, project_id string, action string, stored_id {kind}, is_acceptable boolean, quality_score double, "
        "expected long, links long, embedded long, failed long, outcome string, batch int"
    )
    return spark.read.schema(schema).parquet(f"{base}/verdict")
