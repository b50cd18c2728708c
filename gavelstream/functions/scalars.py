"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def count_char(text: Column, char: str) -> Column:
    """How often the character stands in the text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def register_count_char(spark: SparkSession) -> None:
    """count_char for SQL text, as a SQL function that the optimizer inlines."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_char(s STRING, c STRING) RETURNS BIGINT"
        " RETURN cast(length(s) - length(replace(s, c, '')) AS bigint)"
    )


def regex_group_or_null(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null, not empty, if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def split_index(text: Column, separator: str, index: int) -> Column:
    """The part of the text at a 0-based index; null beyond the last."""
    return F.get(F.split(text, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E"))), index)


def json_path(raw: Column, path: str, kind: str) -> Column:
    """The value at a path such as memory_stats.usage, cast to kind."""
    return F.get_json_object(raw, f"$.{path}").cast(kind)


def array_average(values: Column) -> Column:
    """The mean of an array of numbers; null if it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values))


def day(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def minute(time: Column) -> Column:
    return F.date_format(time, "HH:mm")


def euros(price: Column) -> Column:
    """Dollars to euros at the workload's fixed rate."""
    return (F.expr("0.908BD") * price).cast("decimal(23,3)")
