"""Registration of queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import SPACE_CHARS, SPACE_RANGES
from ..sources import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACES = f"[{SPACE_RANGES}]+"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows in DuckDB."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def sql_strip(x: str) -> str:
    return f"trim({x}, '{SPACE_CHARS}')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACES}'), lambda w: w <> '')"


def sql_vectors(name: str, source: str, ident: str, text: str) -> str:
    """CTEs ``<name>`` (id, b, x) and ``<name>_n`` (id, n): hashed word counts."""
    return f"""
    {name}_w AS (SELECT {ident} AS id, unnest({sql_words(f'lower({text})')}) AS w FROM {source}),
    {name} AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS x
               FROM {name}_w GROUP BY 1, 2),
    {name}_n AS (SELECT d.{ident} AS id, coalesce(sqrt(sum(v.x * v.x)), 0) AS n
                 FROM {source} d LEFT JOIN {name} v ON v.id = d.{ident} GROUP BY 1)"""


def sql_scores(q: str, d: str) -> str:
    """CTE ``scores`` (qid, id, score) of all pairs of two vector CTEs."""
    return f"""
    dots AS (SELECT a.id AS qid, c.id AS id, sum(a.x * c.x) AS dot FROM {q} a JOIN {d} c ON a.b = c.b GROUP BY 1, 2),
    scores AS (SELECT a.id AS qid, c.id AS id,
                 round(CASE WHEN a.n * c.n = 0 THEN 0 ELSE coalesce(t.dot, 0) / (c.n * a.n) END, 6) AS score
               FROM {q}_n a CROSS JOIN {d}_n c LEFT JOIN dots t ON t.qid = a.id AND t.id = c.id)"""


__all__ = ["F", "QUERIES", "ORACLES", "SPACES", "load", "query", "spread", "sql_strip", "sql_words", "sql_vectors", "sql_scores"]
