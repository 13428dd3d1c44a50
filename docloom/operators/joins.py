"""Lookups, counts per parent, orphans, previews, parent checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import visible


def with_child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with one count column per child table; 0 where there are none.

    Each child is aggregated before it meets the parents, so a parent with
    very many children costs one row.
    """
    out = visible(parents)
    for name, child in children.items():
        counts = visible(child).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def hits_to_chunks(hits: DataFrame, chunks: DataFrame, document: Column | None = None) -> DataFrame:
    """Ranked hits with their stored chunk rows; ``document`` filters after
    the top k, so fewer rows than asked for may remain."""
    joined = hits.join(chunks, "embedding_id")
    return joined.filter(F.col("document_id") == document) if document is not None else joined


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Visible rows whose key is listed."""
    return visible(df).join(ids.select(key), key, "left_semi")


def orphans(points: DataFrame, entries: DataFrame, key: str = "redis_key") -> DataFrame:
    """Points whose entry is gone; a point without a key is not an orphan."""
    return points.filter(F.col(key).isNotNull()).join(entries.select(key), key, "left_anti")


def preview(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document text, else its chunks in order joined by blank lines.

    Only documents without text pull their chunks, and one document's chunks
    are no longer than the document was.
    """
    blank = F.coalesce(F.col("markdown_content"), F.lit("")) == ""
    bare = docs.filter(blank).select("document_id")
    joined = (
        chunks.filter(F.coalesce("content", F.lit("")) != "").join(bare, "document_id", "left_semi").groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_parts"))
        .select("document_id", F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n").alias("_joined"))
    )
    text = F.when(blank, F.coalesce("_joined", F.lit(""))).otherwise(F.col("markdown_content"))
    return docs.join(joined, "document_id", "left").withColumn("preview", text).drop("_joined")


def check_parents(messages: DataFrame) -> DataFrame:
    """Adds ``parent_ok``: no parent, or one in the same session."""
    parents = messages.select(F.col("message_id").alias("parent_id"), F.col("session_id").alias("_of"))
    # messages without a parent skip the join: their null key would be hot
    roots = messages.filter(F.col("parent_id").isNull()).withColumn("parent_ok", F.lit(True))
    replies = messages.filter(F.col("parent_id").isNotNull()).join(parents, "parent_id", "left")
    replies = replies.withColumn("parent_ok", F.coalesce(F.col("_of") == F.col("session_id"), F.lit(False)))
    return roots.unionByName(replies.drop("_of"))


def merge_snapshots(tasks: DataFrame, snaps: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Task rows with the newest snapshot on top; 0 and '' count as missing."""
    types = {f.name: f.dataType.typeName() for f in snaps.schema.fields}
    fresh = snaps.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields])

    def merged(f: str) -> Column:
        empty = F.lit("") if types[f] == "string" else F.lit(0)
        return F.coalesce(F.nullif(F.col(f"_s_{f}"), empty), F.col(f))

    joined = tasks.join(fresh, key, "left")
    return joined.select(*[merged(c).alias(c) if c in fields else F.col(c) for c in tasks.columns])


def join_fields(df: DataFrame, by: str, field: str = "content", sep: str = "\n\n", order: str = "pos") -> DataFrame:
    """One text per group: the non-empty values of a field, in order.

    The result is one string per group, so groups must be as small as the
    result lists they stand for.
    """
    filled = df.filter(F.coalesce(F.col(field).cast("string"), F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(field).cast("string").alias("v"))))
    return filled.groupBy(by).agg(parts.alias("_p")).select(
        by, F.array_join(F.transform("_p", lambda p: p["v"]), sep).alias("joined")
    )
