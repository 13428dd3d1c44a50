"""Failures, retries, resumption, re-indexing and deletion over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.query import delete_where, hard_delete, soft_delete

MAX_TRIES = 3


def classify_failures(df: DataFrame) -> DataFrame:
    """Task and document status from ``error_class``, ``is_retryable`` and,
    for finished runs, whether chunks failed."""
    e = F.col("error_class")
    retry = (e == "ReconciliationError") | F.coalesce("is_retryable", F.lit(False))
    ok = e.isNull()
    partial = F.coalesce("has_partial_failures", F.lit(False))
    task = (
        F.when(ok & partial, "partial_success").when(ok, "completed")
        .when(e == "QuarantineException", "failed_permanent").when(retry, "failed_retryable")
        .otherwise("failed_permanent")
    )
    doc = (
        F.when(ok & partial, "partially_available").when(ok, "ready")
        .when(e == "QuarantineException", "quarantined").when(retry, "processing").otherwise("failed")
    )
    return df.withColumn("task_status", task).withColumn("document_status", doc)


def pending(df: DataFrame, done: DataFrame, step: str, key: str = "document_id") -> DataFrame:
    """Rows whose step is not done, so a resumed run skips finished work."""
    finished = done.filter((F.col("step") == step) & (F.col("action") == "completed")).select(key).distinct()
    return df.join(finished, key, "left_anti")


def backoff(attempt: Column, base: float = 60.0, longest: float = 3600.0) -> Column:
    """Seconds until the next try, doubling and capped."""
    return F.least(F.lit(longest), base * F.pow(F.lit(2.0), attempt - 1))


def retry_plan(failures: DataFrame, key: str = "task_id", max_tries: int = MAX_TRIES) -> DataFrame:
    """Tries per task and where it goes: ``retry`` with a delay, or ``dead_letter``.

    ``failures``: one row per failed try. The first run and ``max_tries``
    retries are allowed.
    """
    tries = failures.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"))
    dead = F.col("attempts") > max_tries
    return tries.select(
        key, "attempts", F.when(dead, "dead_letter").otherwise("retry").alias("route"),
        F.when(~dead, backoff(F.col("attempts"))).alias("delay_seconds"),
    )


def reindex(docs: DataFrame, pick: Column, now: Column, user: Column) -> tuple[DataFrame, DataFrame]:
    """New tasks for the picked visible documents, and the documents with
    their status set to processing."""
    chosen = pick & ~F.col("is_deleted")
    tasks = docs.filter(chosen).select(
        F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), now.cast("string")), 256).alias("task_id"),
        "document_id", "project_id", user.alias("user_id"), F.lit("pending").alias("status"),
        F.lit(0.0).alias("progress"), now.alias("created_at"),
    )
    updated = docs.withColumn("status", F.when(chosen, F.lit("processing")).otherwise(F.col("status")))
    return tasks, updated


def delete_cascade(
    docs: DataFrame, chunks: DataFrame, vectors: DataFrame, keys: DataFrame, now: Column, hard: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and vectors after deleting the listed documents.

    Rows are marked or dropped; vectors always go.
    """
    gone = keys.select("document_id").distinct()
    if hard:
        return tuple(hard_delete(t, gone, "document_id") for t in (docs, chunks, vectors))
    return (
        soft_delete(docs, gone, "document_id", now),
        soft_delete(chunks, gone, "document_id", now),
        hard_delete(vectors, gone, "document_id"),
    )


def drop_vectors(vectors: DataFrame, document: Column | None = None, any_of: DataFrame | None = None,
                 file_name: Column | None = None) -> DataFrame:
    """Remove vectors by document, by a list of documents, or by file name."""
    out = vectors
    if document is not None:
        out = delete_where(out, F.col("document_id") == document)
    if any_of is not None:
        out = hard_delete(out, any_of, "document_id")
    if file_name is not None:
        out = delete_where(out, F.col("file_name") == file_name)
    return out
