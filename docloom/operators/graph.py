"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b): the least node reachable.

    Each round points the larger neighbours of a node, then the smaller ones, at the least node of
    its neighbourhood, until nothing moves. Rounds grow with the logarithm of a component's size;
    neighbourhoods are only ever aggregated, never gathered, and ``checkpoint()`` in the shared
    folder cuts the lineage. Links with a null end are left out; a node linked to itself alone is a
    component of its own.
    """
    shared_dir(links.sparkSession)
    known = links.filter("a IS NOT NULL AND b IS NOT NULL")
    now = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        outer = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        outer = outer.unionByName(now.filter("a = b")).distinct()
        low = outer.groupBy("a").agg(F.min("b").alias("m"))
        inner = outer.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = inner.unionByName(low.withColumnRenamed("m", "b")).distinct().checkpoint()
    return now.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node is linked to one node only, and that to itself at most."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return ends.filter("low <> high").isEmpty()
