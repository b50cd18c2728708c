"""Rows by rank within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group by order, with their rank as a long if a name is given.

    Spark limits each group within a task before the shuffle, so a hot group
    costs n rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked.withColumn(name, F.col(name).cast("long")) if rank else ranked.drop(name)


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Deduplication that keeps the last row of each group."""
    return top_rows(df, keys, order, 1)


def top_overall(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of all, by a bounded heap per task."""
    return df.orderBy(*order).limit(n)
