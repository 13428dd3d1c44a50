"""Keeping hot keys apart: joins and running sums that survive skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000


def attach(big: DataFrame, per_key: DataFrame, key: str, count: str, row_id: list[str]) -> DataFrame:
    """Left-join one-row-per-key facts onto many rows, safe for hot keys.

    A key is hot when it holds more than 1/1000 of all rows, so there can be
    at most 1000 hot keys: their facts are broadcast, and their rows take a
    scattered join key for the shuffled join that serves all other keys.
    ``count`` is the column of ``per_key`` with the key's row count.
    """
    facts = [c for c in per_key.columns if c != key]
    limit = per_key.agg((F.sum(count) / HOT_KEYS).alias("limit")).scalar()
    packed = per_key.select(F.col(key), F.struct(*facts).alias("_facts"))
    hot = packed.filter(F.col(f"_facts.{count}") > limit).withColumnRenamed("_facts", "_hot")
    cold = packed.filter(F.col(f"_facts.{count}") <= limit).withColumnsRenamed({key: "_key", "_facts": "_cold"})
    tagged = big.join(F.broadcast(hot), key, "left")
    scattered = F.concat(F.lit("\x00"), F.xxhash64(*row_id).cast("string"))
    tagged = tagged.withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(scattered)
    )
    cold = cold.withColumn("_key", F.col("_key").cast("string"))
    joined = tagged.join(cold, "_key", "left")
    fact = F.coalesce("_hot", "_cold")
    return joined.select(*big.columns, *[fact[c].alias(c) for c in facts])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column
) -> DataFrame:
    """Running sum per key in ``order``, in two levels.

    ``bucket`` must rise with ``order``. Buckets are summed first, so a hot key
    is spread over as many tasks as it has buckets.
    """
    parts = df.withColumn("_bucket", bucket)
    totals = parts.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(totals, [*keys, "_bucket"])
        .withColumn(out, F.sum(value).over(within) + F.col("_before"))
        .drop("_bucket", "_before")
    )
