"""The corpus operators as queries over the given tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, importance, language, line_rules, mixing, quality, ranked_search, recompression, secrets, setsketch, sharding, token_files
from .common import crc, read
from .sql import LINE_RULES_SQL, NEAR_SQL, REPEATS_SQL, RESAMPLE_SQL, SEARCH_SQL, SECRETS_SQL, VECTORS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_secret_scan", SECRETS_SQL)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_examples")


@query("op2_language_backoff")
def language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", crc(F.col("doc_id")) % 3 == 1)
    model = language.learn(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, keep=("doc_id", "held_out"))


@query("op3_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_recompression_dedup", REPEATS_SQL)
def recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(read(spark, sf_dir, "documents"))


@query("op5_subword_quality")
def subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sample = quality.training_rows(docs, read(spark, sf_dir, "labels"), "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0")
    scored = quality.score(docs, quality.learn(sample))
    return scored.withColumn("held_out", crc(F.col("doc_id")) % 5 == 0).select("doc_id", "held_out", "score", "predicted")


@query("op6_line_rules", LINE_RULES_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.apply_line_rules(read(spark, sf_dir, "documents"))
    return judged.drop("clean_text")


@query("op7_projection_forest", VECTORS_SQL)
def projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op8_label_propagation_shards")
def label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op9_setsketch_near_dedup", NEAR_SQL)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op11_importance_resampling", RESAMPLE_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_k2_treap_search", SEARCH_SQL)
def k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_files.write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_store(store)
