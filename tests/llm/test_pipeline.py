"""Each stage of the pipeline against what its operator should leave."""

import base64

import pytest

import corpus_pipeline
from docloom.llm import line_rules, setsketch
from docloom.llm.secrets import base_spans

from .test_operators import PATTERN, RANKS, SCHEMA, corpus


def test_stages(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before, tables = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        tables.append(before)
    ruled, unique, masked, mixed, ids = tables
    assert all(t.columns == corpus_pipeline.COLUMNS for t in tables[:4])
    judged = [line_rules.judge(r[1]) for r in corpus()]
    assert sorted(r["text"] for r in ruled.collect()) == sorted(j["clean_text"] for j in judged if j["kept"])
    kept = {r["doc_id"] for r in setsketch.near_duplicates(ruled).filter("kept").collect()}
    assert {r["doc_id"] for r in unique.collect()} == kept and len(kept) < ruled.count()
    assert masked.count() == unique.count() and not any(base_spans(r["text"]) for r in masked.collect())
    vocabulary = set(" ".join(r["text"] for r in masked.collect()).split())
    assert set(" ".join(r["text"] for r in mixed.collect()).split()) <= vocabulary
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {(r["doc_id"], tuple(own.encode_ordinary(r["text"]))) for r in mixed.collect()}
    assert {(r["doc_id"], tuple(r["ids"])) for r in ids.collect()} == texts
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == ids.count()


def test_rows_of_one_doc_id_are_masked_by_their_own_spans(spark):
    first, second = "AKIA" + "A1" * 8, "AKIA" + "B2" * 8
    rows = [(i, t, "en", s, 0) for i, t, s in [
        (None, f"{first} and plain words", "a"), (None, f"some plain words before {second}", "a"), (None, "no secret in this text at all", None),
        (4, f"{first} again", "b"), (4, f"other words, then {second}", "b"), (4, None, "b"), (5, "nothing here", "b"),
    ]]
    got = corpus_pipeline.secret_scan(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(i, t and t.replace(first, "[SECRET]").replace(second, "[SECRET]"), lang, s) for i, t, lang, s, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got.collect())


def test_texts_of_one_doc_id_are_no_near_copies(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, a + " tail", "en", "s", 1), (None, "x y", "en", "s", 1), (None, "x z", "en", "s", 1)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows + rows[:1], SCHEMA), "").collect()
    assert len(got) == 4 and sum(r["text"].startswith("a0") for r in got) == 1
    assert {r["text"] for r in got} >= {b, "x y", "x z"}


def test_clean_short_lines_stay(spark):
    """Phrases inside words or sentences, headings, lists and table rows: nothing of them is lost."""
    clean = [
        "An analog input drives the filter.", "The catalog includes birds.", "The dialog in act two", "They spread more seeds.",
        "## Methods", "# A", "* one item", "- another item", "> a quoted line", "| a | b |", "|---|---|", "| 1 | 2 |", "Click here is what the old manual told its readers to do.",
    ]
    clean += [f"Line{i} holds{i} words{i} of{i} its{i} own{i}." for i in range(12)]
    bad = ["Home | News | About | Login", "All rights reserved.", "Read more", "* Log in", "Buy!! Now!! Go??", "$$$ *** &&& cheap", "| sign up | log in |"]
    text, mixed = "\n".join(clean), "\n".join([*clean, *bad])
    rows = [(1, text, "en", "s", 0), (2, mixed, "en", "s", 0)]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: text, 2: text}
    assert line_rules.judge(text)["lost_words"] > 0  # by the rule of the SQL
