"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(value: Column, time: Column) -> Column:
    """The value at the latest time."""
    return F.max_by(value, time)


def top_k(df: DataFrame, keys: list[str], value: str, k: int, extra: list[str] | None = None) -> DataFrame:
    """keys, top: the k largest of value in each group, as an array in falling order.

    With extra columns the entries are structs. Rows beyond the k-th are left
    out by a rank before they are collected, and Spark ranks within each task
    before the shuffle, so that no group is gathered whole.
    """
    from gavelstream.operators.ranking import top_rows

    columns = [value, *(extra or [])]
    kept = top_rows(df.select(*keys, *columns), keys, [F.col(value).desc(), *[F.col(c).asc() for c in extra or []]], k, "_rank")
    entry = F.struct(*columns) if extra else F.col(value)
    listed = F.array_sort(F.collect_list(F.struct("_rank", entry.alias("_entry"))))
    return kept.groupBy(*keys).agg(F.transform(listed, lambda x: x["_entry"]).alias("top"))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, True))
