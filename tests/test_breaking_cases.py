"""Inputs that once broke an operator."""

import time

import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.functions import chunking, masking, numbers
from docloom.operators import aggregates, dedup
from docloom.operators.windows import working_memory
from docloom.sources.tables import html_text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_pages_with_gaps(spark):
    pages = spark.createDataFrame([("d", n) for n in range(5, 60, 5)] + [("e", n) for n in range(1, 41)], "document_id string, page_no int")
    got = sorted(tuple(r) for r in aggregates.sample_pages(pages).select("document_id", "page_no").collect())
    assert [n for d, n in got if d == "d"] == list(range(5, 60, 5))
    assert [n for d, n in got if d == "e"] == list(range(1, 31, 2))


@pytest.mark.parametrize("value", ["12345", "array('hunter2')", "named_struct('v', 'hunter2')", "map('v', 'hunter2')"])
def test_masks_every_type_of_map_value(spark, value):
    df = spark.sql(f"SELECT map('api_token', {value}, 'note', {value}) AS m")
    got = masking.mask_keys(df, "m").first()["m"]
    assert got["api_token"] == "[MASKED]"
    assert "12345" in got["note"] or "hunter2" in got["note"]


def test_masks_inside_a_kept_map_value(spark):
    got = masking.mask_keys(spark.sql("SELECT map('note', named_struct('password', 'longenough', 'n', 1)) AS m"), "m").first()["m"]
    assert "longenough" not in got["note"] and '"n":1' in got["note"]


@pytest.mark.parametrize("text, tokens", [("\t\n\r ", 0), ("  ", 0), ("\tabcdefg", 2)])
def test_blank_text_has_no_tokens(spark, text, tokens):
    assert one(spark, numbers.token_estimate(F.col("t")), t=text) == tokens


def test_last_of_repeated_updates_stands(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "id int, v string, step int")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "p", 2), (3, "q", 1)], "id int, v string, step int")
    got = {(r["id"], r["v"]) for r in dedup.upsert(target, updates, "id", ["step"]).collect()}
    assert got == {(1, "a"), (2, "y"), (3, "p"), (None, "n")}


def test_memory_lists_every_turn(spark):
    rows = [("t", n, "go", f"act{n}", "ok", None) for n in range(1, 15)]
    turns = spark.createDataFrame(rows, "task_id string, turn_number int, directive string, action string, outcome string, last_error string")
    last = working_memory(turns).filter("turn_number = 14").first()["memory"]
    assert all(f"Action: act{n}\n" in last for n in range(1, 15))


@pytest.mark.parametrize("entity, char", [("&#8217;", "’"), ("&eacute;", "é"), ("&mdash;", "—"), ("&#x27;", "'"), ("&amp;lt;", "&lt;")])
def test_entities(spark, entity, char):
    assert one(spark, html_text(F.col("h")), h=f"<p>a{entity}b</p>") == f"a{char}b"


@pytest.mark.parametrize("text", ["", "a\nb\r\nc" * 50, "\U0001f600é" * 700, "x" * 512, "x" * 513])
def test_fixed_slices(spark, text):
    assert one(spark, chunking.fixed(F.col("t")), t=text) == [text[i : i + 512] for i in range(0, len(text), 512)]


def test_fixed_is_linear(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("abcdefg é\n"), n).alias("t")).select(F.size(chunking.fixed(F.col("t"))).alias("n"))
        start = time.perf_counter()
        df.collect()
        return time.perf_counter() - start

    seconds(1000)
    small, large = min(seconds(100_000) for _ in range(3)), min(seconds(400_000) for _ in range(3))
    assert large < 8 * small + 1


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
