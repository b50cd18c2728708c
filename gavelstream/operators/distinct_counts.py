"""Many filtered distinct counts in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_counts(df: DataFrame, keys: list[str], ids: dict[str, str], ranks: dict[str, Column], rows: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per group: rows and rows per rank, and distinct ids and distinct ids per rank.

    ids names the columns whose values are counted (output name -> column);
    ranks are conditions; extra are maxima. Each row becomes one small row per
    id column, grouped by id with a flag per rank, then by the keys. That is two
    groupings with partial sums however many filters there are, where a plan of
    separate distinct aggregates copies each row once for each of them.
    """
    extra = extra or {}
    flags = {f"_in_{r}": c for r, c in ranks.items()}
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("_kind"), F.col(column).alias("_id")) for name, column in ids.items()])).alias("_one")
    small = df.select(*keys, *[c.alias(f) for f, c in flags.items()], *[c.alias(n) for n, c in extra.items()], kinds).select("*", "_one.*").drop("_one")
    by_id = small.groupBy(*keys, "_kind", "_id").agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(f)).alias(f"_n{f}") for f in flags],
        *[F.max(n).alias(n) for n in extra],
    )
    first = next(iter(ids))
    of_first = F.col("_kind") == first

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(of_first, F.col(column))), F.lit(0)).cast("long")

    def distinct(name: str, when: Column | None = None) -> Column:
        known = (F.col("_kind") == name) & F.col("_id").isNotNull()
        return F.count_if(known if when is None else known & when)

    return by_id.groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in extra],
        total("_n").alias(f"total_{rows}"),
        *[total(f"_n_in_{r}").alias(f"{r}_{rows}") for r in ranks],
        *[c for name in ids for c in (distinct(name).alias(f"total_{name}"), *[distinct(name, F.col(f"_n_in_{r}") > 0).alias(f"{r}_{name}") for r in ranks])],
    )
