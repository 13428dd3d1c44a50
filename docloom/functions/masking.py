"""Redaction and masking inside nested data, driven by the schema.

The schema decides the shape of the rewrite once, on the driver; rows are
rewritten by plain column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv
from .text import redact


def _rewrite(c: Column, kind: T.DataType, leaf: Callable[[Column], Column]) -> Column:
    """Apply ``leaf`` to every string value at any depth."""
    if isinstance(kind, T.StringType):
        return leaf(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _rewrite(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _rewrite(v, kind.valueType, leaf))
    if isinstance(kind, T.StructType):
        fields = [_rewrite(c[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def redact_nested(df: DataFrame, col: str) -> DataFrame:
    """Redact credentials in all strings of a nested column."""
    return df.withColumn(col, _rewrite(F.col(col), df.schema[col].dataType, redact))


def _mask_text(v: Column) -> Column:
    return F.when(F.length(v) > 8, F.concat(F.substring(v, 1, 6), F.lit("...[MASKED]"))).otherwise(F.lit("[MASKED]"))


def _sensitive(name: str) -> bool:
    return any(k in name.lower() for k in fv.SENSITIVE_KEYS)


def _sensitive_key(key: Column) -> Column:
    hit = F.lit(False)
    for name in fv.SENSITIVE_KEYS:
        hit = hit | F.contains(F.lower(key), F.lit(name))
    return hit


def _mask(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            inner = c[f.name]
            if _sensitive(f.name):
                inner = _mask_text(inner) if isinstance(f.dataType, T.StringType) else F.lit("[MASKED]")
            else:
                inner = _mask(inner, f.dataType)
            fields.append(inner.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        inner = kind.valueType
        if isinstance(inner, T.StringType):
            def value(k: Column, v: Column) -> Column:
                # a null under a sensitive key is masked like any non-string
                return F.when(_sensitive_key(k), F.coalesce(_mask_text(v), F.lit("[MASKED]"))).otherwise(v)

            return F.transform_values(c, value)
        if not isinstance(kind.keyType, T.StringType):
            return F.transform_values(c, lambda k, v: _mask(v, inner))
        # values must be text to hold [MASKED]; the others are given as their JSON, masked inside
        nested = isinstance(inner, (T.StructType, T.MapType, T.ArrayType))

        def as_text(k: Column, v: Column) -> Column:
            kept = F.to_json(_mask(v, inner)) if nested else v.cast("string")
            return F.when(_sensitive_key(k), F.lit("[MASKED]")).otherwise(kept)

        return F.transform_values(c, as_text)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        return F.transform(c, lambda x: _mask(x, kind.elementType))
    return c


def mask_keys(df: DataFrame, col: str) -> DataFrame:
    """Mask values by key name at any depth. A sensitive field that is no
    string becomes the text ``[MASKED]``; a map by names whose values are no
    strings becomes a map of their texts (JSON), with ``[MASKED]`` likewise."""
    return df.withColumn(col, _mask(F.col(col), df.schema[col].dataType))
