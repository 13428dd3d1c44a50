"""First-wins de-duplication, upserts and set-like operators.

``row_number() <= 1`` is planned with a partial group limit before the
shuffle, so each map task sends one row per key, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """First row per key by ``order``; null keys form one group."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def unique(df: DataFrame, order: list[str]) -> DataFrame:
    """Whole-row distinct that keeps the first copy by ``order``."""
    rest = [c for c in df.columns if c not in order]
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() == "map"}
    prints = [F.to_json(c).alias(f"_k{i}") if c in maps else F.col(c).alias(f"_k{i}") for i, c in enumerate(rest)]
    keyed = df.select("*", *prints)
    return dedupe(keyed, [f"_k{i}" for i in range(len(rest))], order).drop(*[f"_k{i}" for i in range(len(rest))])


def latest(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """Newest row per key; pass descending columns."""
    return dedupe(df, key, order)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Target plus the first row of every key that it does not hold yet."""
    return target.unionByName(new_rows(target, rows, key, order))


def new_rows(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows that ``insert_if_absent`` would add."""
    return dedupe(rows, key, order).join(target.select(*key).distinct(), key, "left_anti").select(*rows.columns)


def upsert(target: DataFrame, updates: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """Replace on equal key, else add; of repeated updates the last by ``order`` stands.

    Without ``order`` the keys of ``updates`` must be unique. A null key matches nothing: such
    rows of the target stay, and one such update at most is added.
    """
    if order:
        updates = dedupe(updates, key, [F.desc(c) if isinstance(c, str) else c for c in order])
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def union_first_wins(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union in list order, first occurrence of each key wins."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    return dedupe(whole, key, ["_src", *order]).drop("_src")


def classify_documents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each uploaded file, by content hash within project.

    ``incoming``: document_id, project_id, content_hash, arrived (order);
    ``existing``: document_id, project_id, content_hash, status, chunk_count,
    is_deleted. Adds ``action`` and ``is_new``; a repeat within the batch is
    judged against the first copy, which is pending with no chunks by then.
    """
    key = ["project_id", "content_hash"]
    first = (
        incoming.groupBy(*key)
        .agg(F.min_by("document_id", F.struct("arrived", "document_id")).alias("first_id"))
        .join(
            existing.select(
                *key,
                F.col("document_id").alias("existing_id"),
                F.col("is_deleted").alias("_gone"),
                (F.col("status").isin("failed", "pending", "cancelled") | (F.col("chunk_count") == 0)).alias("_redo"),
            ),
            key, "left",
        )
        .withColumn(
            "first_action",
            F.when(F.col("existing_id").isNull(), "create").when(F.col("_gone"), "reactivate")
            .when(F.col("_redo"), "reingest").otherwise("cached"),
        )
        .select(*key, "first_id", "existing_id", "first_action")
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    out = incoming.alias("a").join(first.alias("b"), same, "left").select("a.*", "first_id", "existing_id", "first_action")
    repeat = F.col("document_id") != F.col("first_id")
    action = F.when(~repeat, F.col("first_action")).when(F.col("first_action") == "cached", "cached").otherwise("reingest")
    return out.select(
        *incoming.columns,
        F.coalesce("existing_id", "first_id").alias("stored_id"),
        action.alias("action"),
        (action != "cached").alias("is_new"),
    )


def dedup_chunks(chunks: DataFrame, existing: DataFrame | None = None, arrived: Column | None = None) -> DataFrame:
    """Owner document of every chunk by global content hash.

    ``chunks``: document_id, chunk_index, chunk_hash, ...; adds
    ``owner_document_id`` and ``is_new`` (the stored owner is this document).
    The owner is the earliest by (arrival, document, index) or the one stored.
    """
    by = F.struct(arrived if arrived is not None else F.lit(0), "document_id", "chunk_index")
    owners = chunks.groupBy("chunk_hash").agg(
        F.min_by("document_id", by).alias("owner_document_id")
    )
    if existing is not None:
        stored = existing.select("chunk_hash", F.col("document_id").alias("_stored"))
        owners = owners.join(stored, "chunk_hash", "left").select(
            "chunk_hash", F.coalesce("_stored", "owner_document_id").alias("owner_document_id")
        )
    # a content that a third of all chunks share is a skewed partition of this join, which AQE splits
    return chunks.join(owners, "chunk_hash", "left").select(*chunks.columns, "owner_document_id").withColumn("is_new", F.col("owner_document_id") == F.col("document_id"))
