"""Ingestion of whole tables: clean, gate, chunk, dedup, enrich, embed, link,
reconcile. Each stage maps one table to the next; nothing runs per document
on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking as ck
from ..functions import fixed_values as fv
from ..functions.embedding import Embedder, adjacent_similarity, embed
from ..functions.numbers import chunk_fingerprint, content_hash, embedding_fingerprint, token_count
from ..functions.text import enriched, placeholder_summary, sanitize
from ..operators.dedup import dedup_chunks, dedupe, insert_if_absent
from .quality import quality

MODEL = "text-embedding-3-small"


def gate(docs: DataFrame) -> DataFrame:
    """Clean text and quality columns. ``docs``: document_id, project_id,
    text, file_size."""
    cleaned = docs.withColumn("text", sanitize(F.col("text")))
    staged = cleaned.withColumns({"pages": F.lit(1), "profile": F.lit("TEXT")})
    return quality(staged)


def semantic_chunks(text: Column, fn: Embedder | None = None, max_size: int = 1000, min_size: int = 100,
                    overlap_words: int = 200, pct: float = 0.25) -> Callable[[DataFrame], DataFrame]:
    """Adds ``chunks``: sentences grouped by meaning, then the size rules.

    All steps stay in the document's own row; only the similarities of
    neighbouring sentences come from Python.
    """
    def run(df: DataFrame) -> DataFrame:
        d = df.withColumn("_s", ck.prose_sentences(text))
        d = d.withColumn("_sim", adjacent_similarity(F.col("_s"), fn))
        d = d.withColumn("_thr", ck.break_threshold(F.col("_sim"), pct))
        grouped = ck.group_by_similarity(F.col("_s"), F.col("_sim"), F.col("_thr"), max_size, min_size)
        grouped = F.when(F.size("_s") == 0, F.array().cast("array<string>")).otherwise(grouped)
        return d.withColumn("_g", grouped).withColumn(
            "chunks", ck.size_rules(F.col("_g"), min_size, overlap_words)
        ).drop("_s", "_sim", "_thr", "_g")

    return run


def chunk_records(docs: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk with index, hash, fingerprint, tokens and page."""
    numbered = F.arrays_zip(chunks.alias("content"), ck.carried_pages(chunks).alias("page_number"))
    rows = ck.explode_pieces(docs, ["document_id", "project_id"], numbered, "chunk_index", "_c")
    rows = rows.select("document_id", "project_id", "chunk_index", "_c.*").toDF(
        "document_id", "project_id", "chunk_index", "content", "page_number"
    )
    rows = rows.withColumn("chunk_hash", content_hash(F.col("content")))
    return rows.withColumns({
        "chunk_fingerprint": chunk_fingerprint(F.col("document_id"), F.col("chunk_index"), F.col("chunk_hash")),
        "token_count": token_count(F.col("content")),
        "embed_status": F.lit("pending"),
        "chunk_source": F.lit("auto"),
    })


def enrich(chunks: DataFrame, docs: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Title and summary of its document in front of every new chunk.

    ``contents``: document_id, chunk_index, chunk_hash and content, for ``chunks`` that have no content of their own.
    These meet their documents first, so that the contents are shuffled once.
    """
    heads = docs.select(
        "document_id", F.col("file_name").alias("_title"), placeholder_summary(F.col("text")).alias("_summary")
    )
    joined = chunks.join(heads, "document_id")
    if contents is not None:
        place = ["document_id", "chunk_index", "chunk_hash"]
        joined = joined.join(dedupe(contents.select(*place, "content"), place, ["chunk_index"]), place)
    return joined.withColumn(
        "enriched_content", enriched(F.col("_title"), F.col("_summary"), F.col("content"))
    ).drop("_title", "_summary")


def embed_chunks(chunks: DataFrame, fn: Embedder | None = None) -> DataFrame:
    """Vectors of enriched (else raw) text; failures are marked, not raised."""
    text = F.coalesce(F.nullif("enriched_content", F.lit("")), F.col("content"))
    out = chunks.withColumn("vector", F.when(F.coalesce(text, F.lit("")) != "", embed(text, fn)))
    return out.withColumns({
        "embed_status": F.when(F.col("vector").isNull(), "failed").otherwise("completed"),
        "embedding_id": F.when(
            F.col("vector").isNotNull(), embedding_fingerprint(F.col("chunk_hash"), MODEL)
        ),
    })


def reembed(chunks: DataFrame, fn: Embedder | None = None) -> DataFrame:
    """The failed chunks, embedded again; upsert them into the table."""
    return embed_chunks(chunks.filter(F.col("embed_status") == "failed").drop("vector", "embedding_id"), fn)


def link(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Document-to-chunk links, each pair once."""
    rows = chunks.select("document_id", F.col("chunk_hash").alias("chunk_id"))
    return insert_if_absent(existing, rows, ["document_id", "chunk_id"], ["document_id"])


def reconcile_counts(df: DataFrame) -> DataFrame:
    """Verdict per document from its counters.

    Needs expected, links, embedded, new_ids, existing_ids and failed; zero
    counters fall back to the number of processed chunks. The outcome is a
    column: READY, PARTIALLY_AVAILABLE, VIOLATED_LINKS or
    VIOLATED_FAILED_RATIO (the last two are retryable errors).
    """
    processed = F.col("new_ids") + F.col("existing_ids")
    positive = lambda c, other: F.when(F.col(c) > 0, F.col(c)).otherwise(other)
    d = df.withColumns({
        "expected": positive("expected", processed),
        "links": positive("links", processed),
        "embedded": positive("embedded", F.coalesce(F.col("embedded_ids"), F.lit(0)) + F.col("existing_ids"))
        if "embedded_ids" in df.columns else F.col("embedded"),
    })
    ratio = F.col("failed") / F.greatest(F.lit(1), F.col("expected"))
    short = (F.col("expected") > 0) & (F.col("links") < F.floor(F.col("expected") * 0.90))
    outcome = (
        F.when(short, "VIOLATED_LINKS")
        .when((ratio >= fv.MAX_FAILED_RATIO) & (F.col("failed") > 0), "VIOLATED_FAILED_RATIO")
        .when(F.col("failed") > 0, "PARTIALLY_AVAILABLE").otherwise("READY")
    )
    return d.withColumns({
        "failed_ratio": F.round(ratio, 4),
        "matched": (F.col("links") == F.col("expected")) & (F.col("failed") == 0),
        "outcome": outcome,
    })


def reconcile(chunks: DataFrame, links: DataFrame, embedded: DataFrame) -> DataFrame:
    """Counts per document from the stage tables, then the verdict.

    Expected chunks are distinct contents, so repeats inside a document do
    not look like losses. ``embedded``: chunk_hash, embed_status.
    """
    per_doc = chunks.groupBy("document_id", "chunk_hash").agg(F.bool_or("is_new").alias("is_new"))
    with_status = per_doc.join(embedded.select("chunk_hash", "embed_status"), "chunk_hash", "left")
    counts = with_status.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("is_new").alias("new_ids"), F.count_if(~F.col("is_new")).alias("existing_ids"),
        F.count_if(F.col("embed_status") == "completed").alias("embedded"),
        F.count_if(F.col("is_new") & (F.coalesce("embed_status", F.lit("failed")) == "failed")).alias("failed"),
    )
    n_links = links.groupBy("document_id").agg(F.count(F.lit(1)).alias("links"))
    return reconcile_counts(counts.join(n_links, "document_id", "left").fillna(0, ["links"]))


def ingest_report(docs: DataFrame, strategy: str = "fixed", size: int = 512) -> DataFrame:
    """Flagship: per project, what a full ingestion run of a table yields.

    Clean and gate every document, chunk the accepted ones, find each chunk's
    owner by content hash, and report documents, chunks and saved chunks.
    """
    # One pass: refused documents keep one row without a chunk, and facts of a
    # document ride on its first row. The first level of the aggregate is per
    # (project, chunk), so a project with a third of all rows is spread.
    chunks = F.when(F.col("is_acceptable"), ck.chunk(F.col("text"), strategy, size))
    rows = gate(docs).select(
        "project_id", "is_acceptable", "quality_score", F.posexplode_outer(chunks).alias("i", "content")
    )
    first = F.coalesce("i", F.lit(0)) == 0
    rows = rows.select(
        "project_id", content_hash(F.col("content")).alias("chunk_hash"),
        F.when(F.col("content").isNotNull(), token_count(F.col("content"))).alias("t"),
        first.cast("long").alias("d"), (first & F.col("is_acceptable")).cast("long").alias("a"),
        F.when(first, F.col("quality_score")).alias("q"),
    )
    per_chunk = rows.groupBy("project_id", "chunk_hash").agg(
        F.count("chunk_hash").alias("n"), *[F.sum(c).alias(c) for c in ("t", "d", "a", "q")]
    )
    report = per_chunk.groupBy("project_id").agg(
        F.sum("d").alias("documents"), F.sum("a").alias("accepted"), F.sum("q").alias("score"),
        F.sum("n").alias("chunks"), F.count("chunk_hash").alias("distinct_chunks"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
    )
    saved = 1 - F.try_divide("distinct_chunks", "chunks")
    return report.select(
        "project_id", "documents", "accepted", F.round(F.col("score") / F.col("documents"), 4).alias("avg_score"),
        "chunks", "distinct_chunks", "tokens", F.round(F.coalesce(saved, F.lit(0.0)), 6).alias("dedup_ratio"),
    )


def chunk_stage(docs: DataFrame, fn: Embedder | None = None) -> DataFrame:
    """Accepted documents to chunk records with their owners."""
    chunked = semantic_chunks(F.col("text"), fn)(gate(docs))
    # refused documents have no chunks; a filter here would repeat the gate
    return dedup_chunks(chunk_records(chunked, F.when(F.col("is_acceptable"), F.col("chunks"))))
