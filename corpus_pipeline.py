"""From raw documents to token ids: five stages, each written as Parquet and read again.

Every stage judges the whole of what the one before it kept, and its decisions take effect:
quality rules drop rejected documents and the failed lines of the others, near-dedup keeps one
document of each group, secrets are masked, sources are mixed to their targets, and the mix is
encoded. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, line_rules, mixing, secrets, setsketch
from docloom.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    judged = line_rules.apply_line_rules(docs.select(*COLUMNS), ("doc_id", "lang", "source"), line_rules.bad_prose_line).filter("kept")
    text = F.col("clean_text")
    return judged.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    kept = setsketch.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "key")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    rows = docs.select(*COLUMNS).join(kept.distinct(), same).select(*COLUMNS, "key")
    # rows that repeat a kept doc_id with the same words are one document: the least of them stands
    named = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return named.select("doc_id", "r.*").unionByName(rows.filter("doc_id IS NULL").select(*COLUMNS).distinct())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    rows = secrets.find_secrets(docs, keep=("text", "lang", "source"))
    text = secrets.mask_spans(F.col("text"), F.col("secrets"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in the order of the document, white space included."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each mixed document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("byte-level bpe", encode),
]

#: SQL has no form of the permuted mix; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is a table in the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
