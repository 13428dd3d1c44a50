"""Declared schemas, scans, intake of files, and sinks."""

from __future__ import annotations

import html.entities
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import decode_text, file_problem
from ..functions.text import sanitize, strip

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

# envelope of one ingestion event on the wire
EVENT_SCHEMA = (
    "event_id string, seq_num long, task_id string, document_id string, project_id string, status string,"
    " actual_progress double, current_step string, stage_label string, processed_units int, total_units int,"
    " unit_name string, step_upper_bound double, estimated_duration_ms int, error_message string,"
    " timestamp timestamp"
)


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan one table with its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """At least one partition per core for heavy work on a scan.

    Only a scan with fewer splits than cores is shuffled, so large inputs,
    which have plenty of splits, never are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Many files at once, one result row each; a bad file is a row too."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return intake(raw, max_bytes=max_bytes)


def intake(raw: DataFrame, content: str = "content", name: str = "path", max_bytes: int | None = None) -> DataFrame:
    """Validate and decode binary rows: ok, error and text columns."""
    limits = {} if max_bytes is None else {"max_bytes": max_bytes}
    error = file_problem(F.col(content), F.col(name), **limits)
    return raw.withColumn("error", error).withColumn("success", F.col("error") == "").withColumn(
        "text", F.when(F.col("success"), sanitize(decode_text(F.col(content))))
    )


def parse_jsonl(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of JSON lines text; blank and malformed lines are dropped."""
    line = strip(F.col("_line"))
    line = strip(F.regexp_replace(F.regexp_replace(line, "^```json", ""), "```$", ""))
    rows = df.withColumn("_line", F.explode(F.split(F.col(text), "\r\n|\n|\r")))
    parsed = rows.filter(strip(F.col("_line")) != "").withColumn(
        "_ok", F.try_parse_json(line).isNotNull()
    )
    return parsed.filter("_ok").withColumn("row", F.from_json(line, schema)).drop("_line", "_ok")


def html_text(c: Column) -> Column:
    """Readable text of an HTML page."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(
        c, r"(?i)</?(?:p|div|article|section|header|footer|nav|ul|ol|li|table|tr|h[1-6]|title|body|head)\b[^>]*>", "\n\n"
    )
    c = F.regexp_replace(c, r"<[^>]*>", "")
    return sanitize(_decode_entities(F.replace(c, F.lit("&nbsp;"), F.lit(" "))))


_ENTITY = r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# named characters, and the numbers that stand for Windows ones, by the standard library's rules
_NAMED = {n[:-1]: v for n, v in html.entities.html5.items() if n.endswith(";")} | {
    f"#{n}": html.unescape(f"&#{n};") for n in range(128, 160)
}


def _decode_entities(c: Column) -> Column:
    """All named, decimal and hexadecimal entities, each decoded once; unknown names stay."""
    # by first character, for a map is searched from its front
    tables: dict[str, dict[str, str]] = {}
    for name, value in _NAMED.items():
        tables.setdefault(name[0], {})[name] = value
    named = F.from_json(F.lit(json.dumps(tables)), "map<string,map<string,string>>")

    def known_as(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(named, F.substring(name, 1, 1)), name)

    def char(name: Column) -> Column:
        digits = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 9))
        code = digits.try_cast("long")
        wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        known = known_as(F.when(F.startswith(name, F.lit("#")), F.concat(F.lit("#"), code.cast("string"))).otherwise(name))
        number = F.when(wrong, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(known, F.when(F.startswith(name, F.lit("#")), number), F.concat(F.lit("&"), name, F.lit(";")))

    between = F.split(c, _ENTITY, -1)
    chars = F.transform(F.regexp_extract_all(c, F.lit(_ENTITY), 1), char)
    whole = F.zip_with(between, F.concat(chars, F.array(F.lit(""))), lambda t, e: F.concat(t, e))
    return F.when(F.contains(c, F.lit("&")), F.array_join(whole, "")).otherwise(c)


def write_turn_hits(hits: DataFrame, path: str) -> None:
    """Hits of each turn as JSON, one folder per turn."""
    hits.write.mode("append").partitionBy("turn").json(path)


def append_log(df: DataFrame, path: str, date_column: str = "created_at") -> None:
    """Append-only log, one folder per day."""
    df.withColumn("day", F.to_date(date_column)).write.mode("append").partitionBy("day").parquet(path)


def _folder(spark: SparkSession, path: str):
    """A path and its file system, wherever Spark's readers find it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is gone already is no error."""
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def versions(spark: SparkSession, base: str, complete: bool = True) -> list[int]:
    """Numbers of the version folders under ``base``, rising; ``complete``: only those whose write was committed."""
    fs, where = _folder(spark, base)
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    named = [(p.getName(), p) for p in found if p.getName().startswith("v") and p.getName()[1:].isdigit()]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n[1:]) for n, p in named if not complete or done(p))


def read_latest(spark: SparkSession, base: str, schema: T.StructType | str) -> DataFrame:
    """The newest complete version of a table; no rows where there is none.

    A version counts from the moment its writer commits, so readers see the old rows or the new, never a mix.
    """
    known = versions(spark, base)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(base, known[-1]))


def version_path(base: str, number: int) -> str:
    return os.path.join(base, f"v{number:06d}")


def write_version(df: DataFrame, base: str) -> str:
    """Write a table as the next version directory and return its path.

    The old version stays readable, so an upsert may read what it replaces.
    """
    target = version_path(base, max(versions(df.sparkSession, base, complete=False), default=0) + 1)
    df.write.mode("errorifexists").parquet(target)
    return target
