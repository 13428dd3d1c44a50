"""Table queries: filter grammar, visibility, ordering, paging, updates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _predicate(df: DataFrame, name: str, value: Any) -> Column | None:
    field, _, op = name.rpartition("__") if "__" in name else (name, "", "eq")
    if field not in df.columns:
        return None
    c = F.col(field)
    many = list(value) if isinstance(value, (list, tuple)) else [value]
    makers = {
        "eq": lambda: c == value,
        "like": lambda: c.ilike(f"%{value}%"),
        "ilike": lambda: c.ilike(f"%{value}%"),
        "in": lambda: c.isin(many),
        "gte": lambda: c >= value,
        "gt": lambda: c > value,
        "lte": lambda: c <= value,
        "lt": lambda: c < value,
        "is_null": lambda: c.isNull(),
        "is_not_null": lambda: c.isNotNull(),
    }
    # a bare name containing "__eq" is an unknown operator, not equality
    if "__" in name and op == "eq":
        return None
    return makers[op]() if op in makers else None


def apply_filters(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    """AND of ``field__op`` filters; None values and unknown names are skipped."""
    preds = [_predicate(df, k, v) for k, v in (filters or {}).items() if v is not None]
    preds = [p for p in preds if p is not None]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def visible(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Hide soft-deleted rows unless asked for."""
    if include_deleted or "is_deleted" not in df.columns:
        return df
    return df.filter(~F.col("is_deleted"))


def get_by(df: DataFrame, **filters: Any) -> DataFrame:
    """At most one visible row that matches."""
    return apply_filters(visible(df), filters).limit(1)


def exists(df: DataFrame, filters: dict[str, Any]) -> bool:
    """Whether any row matches; soft-deleted rows count."""
    return not apply_filters(df, filters).isEmpty()


def count(df: DataFrame, filters: dict[str, Any] | None = None, include_deleted: bool = False) -> DataFrame:
    """One row with the number of matching rows."""
    return apply_filters(visible(df, include_deleted), filters).agg(F.count(F.lit(1)).alias("total"))


def order(df: DataFrame, keys: list[str], tie_break: str | None = None) -> DataFrame:
    """Multi-key order; ``-`` means descending, nulls are the largest value."""
    cols = []
    for key in keys + ([tie_break] if tie_break else []):
        name = key.removeprefix("-")
        if name in df.columns:
            cols.append(F.desc_nulls_first(name) if key.startswith("-") else F.asc_nulls_last(name))
    return df.orderBy(*cols) if cols else df


def page(
    df: DataFrame, page: int, page_size: int, order_by: list[str], tie_break: str, filters: dict | None = None
) -> DataFrame:
    """One page plus the total. The total is a separate scalar aggregate, so
    the page itself stays a top-n and is never sorted as a whole."""
    rows = apply_filters(visible(df), filters)
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    cut = order(rows, order_by, tie_break).offset((page - 1) * page_size).limit(page_size)
    return cut.withColumn("total", total)


def update_where(df: DataFrame, pred: Column, values: dict[str, Column]) -> DataFrame:
    """Rewrite columns of the matching rows."""
    return df.withColumns({n: F.when(pred, v).otherwise(F.col(n)) for n, v in values.items()})


def soft_delete(df: DataFrame, keys: DataFrame, key: str, now: Column) -> DataFrame:
    """Mark the visible rows whose key is listed as deleted."""
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("is_deleted")
    joined = df.join(marks, key, "left")
    return joined.select(
        *[
            F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "is_deleted"
            else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "deleted_at"
            else F.col(c)
            for c in df.columns
        ]
    )


def hard_delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop the rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """Drop matching rows; rows on which the predicate is null stay."""
    return df.filter(~F.coalesce(pred, F.lit(False)))


def tenant(df: DataFrame, project: Any, column: str = "project_id") -> DataFrame:
    """One project's rows; partition the table by this column to prune."""
    return df.filter(F.col(column) == project)


def writable(df: DataFrame, projects: DataFrame, user: Column) -> DataFrame:
    """Rows of projects that the user owns (the only write permission)."""
    owned = projects.filter(F.col("owner_user_id") == user).select("project_id")
    return df.join(owned, "project_id", "left_semi")
