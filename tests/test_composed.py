"""Composed ingestion: one call, resumed after a failure, and batch by batch."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking as ck
from docloom.functions.embedding import HashingEmbedder
from docloom.plans import composed as cp

SCHEMA = "document_id long, project_id string, file_name string, text string, file_size long"


def documents(n=60, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300]))) for _ in range(n // 2)]
    texts += [rng.choice(texts) for _ in range(n // 3)] + ["", None, "short", "�" * 300]
    return [(i, rng.choice(["p", "q", None]), f"f{i}.md", t, len(t or "")) for i, t in enumerate(texts)]


def rows_of(df):
    return sorted(map(str, df.select("document_id", "project_id", "action", "outcome", "expected", "links", "embedded", "failed").collect()))


def test_verdicts_of_one_call(spark, tmp_path):
    rows = documents()
    out = cp.ingest_batch(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect()
    first, got = {}, {r["document_id"]: r for r in out}
    for i, project, _, text, _ in rows:
        first.setdefault((project, text or ""), i)
    assert len(got) == len(rows) == len(out)
    for i, project, _, text, _ in rows:
        r, own = got[i], first[project, text or ""] == i
        assert r["stored_id"] == first[project, text or ""] and r["action"] == ("create" if own else "cached")
        accepted = len((text or "").strip()) >= 40 and "�" not in text
        assert r["outcome"] == ("CACHED" if not own else "READY" if accepted else "QUARANTINED")
        if own and accepted:
            pieces = {text[k : k + 512] for k in range(0, len(text), 512)}
            assert r["expected"] == r["links"] == r["embedded"] == len(pieces) and r["failed"] == 0


def test_a_stage_that_dies_is_resumed(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    want = rows_of(cp.ingest_batch(docs, str(tmp_path / "whole")))
    base, calls = str(tmp_path / "resumed"), []

    def cut(text):
        calls.append("chunk")
        if len(calls) == 1:
            return F.raise_error(F.lit("worker lost")).cast("array<string>")
        return ck.fixed(text, 512)

    with pytest.raises(Exception, match="worker lost"):
        cp.ingest_batch(docs, base, chunks=cut)
    book = cp.Ledger(spark, base, 0)
    assert [(e["stage"], e["action"]) for e in sorted(book.entries, key=lambda e: e["at"])] == [
        ("intake", "completed"), ("gate", "completed"), ("chunk", "failed")]
    stamp = spark.read.parquet(book.path("gate")).inputFiles()
    assert rows_of(cp.ingest_batch(docs, base, chunks=cut)) == want
    assert spark.read.parquet(book.path("gate")).inputFiles() == stamp  # what was done is not done again
    # and a third call neither builds nor writes anything
    files = {s: spark.read.parquet(book.path(s)).inputFiles() for s in ("chunk", "dedup", "embed", "link", "verdict")}
    assert rows_of(cp.ingest_batch(docs.limit(0), base, chunks=cut)) == want and len(calls) == 2
    assert files == {s: spark.read.parquet(book.path(s)).inputFiles() for s in files}


def test_a_stage_is_tried_three_times(spark, tmp_path):
    docs = spark.createDataFrame(documents(8), SCHEMA)

    def broken(text):
        return F.raise_error(F.lit("always")).cast("array<string>")

    for _ in range(3):
        with pytest.raises(Exception, match="always"):
            cp.ingest_batch(docs, str(tmp_path / "x"), chunks=broken)
    with pytest.raises(RuntimeError, match="failed 3 times"):
        cp.ingest_batch(docs, str(tmp_path / "x"))


def refusing(texts):
    if any("word7 word" in t for t in texts):
        raise ValueError("refused")
    return np.asarray(HashingEmbedder()(texts))


def test_batches_equal_one_run(spark, tmp_path):
    """Files in order of ids, with repeats over files; then the last batch once more."""
    rows = documents(90, 2)
    base = str(tmp_path / "stream")
    for i in range(3):
        part = spark.createDataFrame(rows[i * 28 : (i + 1) * 28 + 28 * (i == 2)], SCHEMA)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    src = spark.readStream.schema(f"{SCHEMA}, f int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("f")
    cp.ingest_stream(src, base, str(tmp_path / "ckpt"), fn=refusing).awaitTermination()
    stream = rows_of(cp.verdicts(spark, base))
    assert stream == rows_of(cp.ingest_batch(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "batch"), fn=refusing))
    assert len({r["outcome"] for r in cp.verdicts(spark, base).collect()}) > 3
    last = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/f=2")
    cp.ingest_batch(last, base, 2, fn=refusing)
    assert rows_of(cp.verdicts(spark, base)) == stream


def test_nothing_to_ingest(spark, tmp_path):
    assert cp.ingest_batch(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_contents_are_stored_where_they_are_made(spark, tmp_path):
    """F8: dedup, enrich and embed wrote, and mostly shuffled, every content again."""
    rows = documents() + [(900, "p", None, "a text of a file without a name, long enough to be accepted", 9)]
    base = str(tmp_path / "a")
    out = {r["document_id"]: r for r in cp.ingest_batch(spark.createDataFrame(rows, SCHEMA), base).collect()}
    stage = lambda name: spark.read.parquet(cp.Ledger(spark, base, 0).path(name))
    assert "content" not in stage("dedup").columns
    assert not {"content", "enriched_content"} & set(stage("embed").columns)
    rich, pieces = stage("enrich"), stage("chunk").select(*cp.PLACE, F.col("content").alias("piece"))
    both = rich.join(pieces, cp.PLACE).collect()
    assert len(both) == rich.count() == stage("embed").count() == pieces.select("chunk_hash").distinct().count()
    for r in both:
        if r["document_id"] == 900:  # nothing to put in front, so the content itself is embedded
            assert r["enriched_content"] is None and r["content"] == r["piece"]
        else:
            assert r["enriched_content"].endswith("\n" + r["piece"]) and r["content"] is None
    assert out[900]["embedded"] == out[900]["expected"] == 1 and out[900]["outcome"] == "READY"


def test_one_file_of_a_stage_is_read_by_many_tasks(spark, tmp_path):
    """a small batch's stage was one file of one row group, so one task did the next stage's work."""
    rng = random.Random(3)
    book = cp.Ledger(spark, str(tmp_path), 0)
    many = spark.createDataFrame([("%0400x" % rng.getrandbits(1600),) for _ in range(60_000)], "text string").coalesce(1)
    rows = book.run("gate", lambda: many)
    groups = [pq.ParquetFile(f[7:] if f.startswith("file://") else f).num_row_groups for f in rows.inputFiles()]
    assert len(groups) == 1 and groups[0] > 1 and rows.count() == 60_000
