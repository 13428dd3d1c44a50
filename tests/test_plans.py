"""The physical plans are the ones that scale."""

import pytest
from pyspark.sql import functions as F

from docloom.catalog import QUERIES
from docloom.operators import dedup, skew


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = {
    "win7_adjacent_similarity", "agg13_break_threshold", "chk5_semantic_groups", "semantic_chunker", "vec1_embed", "vec3_topk_cosine", "vec3_topk_tenant",
    "joi10_query_corpus_best", "win1_search_many", "joi2_hits_to_chunks", "vec4_retrieve", "vec5_kmeans", "vec6_semantic_cache", "vec7_memory_recall",
    "vec8_scope_score", "vec9_approximate_topk", "vec10_reembed_failed", "vec11_deep_search", "set4_fanout", "ord4_rank_bm25", "ord4_rank_hybrid",
    "udf2_pluggable_embedder", "pip10_extract_many", "stm3_upload_rate_limit", "stm4_chat_limits", "str18_turn_brief",  # the last only names it in its text
}
STREAMS = {n for n in QUERIES if n.startswith("stm") and ("stream" in n or n.startswith("stm10"))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - {"vec11_deep_search"}))
def test_no_cross_product_and_no_needless_python(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["win1_rank_per_group", "win2_latest_per_key", "set1_dedupe_first", "vec3_topk_cosine"])
def test_ranking_is_cut_before_the_shuffle(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_pages_are_not_sorted_as_a_whole(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["ord2_page_with_total"](spark, sf))


def formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = formatted(spark, QUERIES["src1_table_scan"](spark, sf))
    assert "GreaterThan(l_discount,0.05)" in text and "l_tax" not in text
    assert "EqualTo(source,src3)" in formatted(spark, QUERIES["fil5_tenant_isolation"](spark, sf))


@pytest.mark.parametrize("name", ["semantic_chunker", "ingest_report", "chk2_sentence", "vec1_embed"])
def test_texts_are_worked_on_once(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert text.count("FileScan") == 1
    assert text.count("ArrowEvalPython") <= 1
    # no filter repeats the expensive array
    assert not any(" Filter " in line and "transform(" in line for line in text.splitlines())


@pytest.mark.parametrize("name", ["vec4_retrieve", "joi2_hits_to_chunks", "vec7_memory_recall"])
def test_payloads_are_fetched_without_shuffling_the_corpus(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_hot_keys_are_broadcast_apart(spark):
    big = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("k"))
    facts = big.groupBy("k").agg(F.count("*").alias("n"))
    text = plan(skew.attach(big, facts, "k", "n", ["id"]))
    assert "BroadcastHashJoin" in text and "Subquery" in text


def test_distinct_count_is_two_level(spark, sf):
    text = plan(QUERIES["agg4_dedup_ratio"](spark, sf))
    assert "hashpartitioning(source" in text and "chunk_hash" in text.split("hashpartitioning(source")[2]


def test_dedupe_shuffles_once(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    assert plan(dedup.dedupe(df, "k", ["id"])).count("Exchange hashpartitioning") == 1
