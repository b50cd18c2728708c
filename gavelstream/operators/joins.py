"""Joins that take more than an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_bids(auction: DataFrame, bid: DataFrame) -> DataFrame:
    """Auctions with their bids between opening and expiry, both ends inclusive; the bid's columns as bid_*."""
    b = bid.select("auction", "bidder", "price", F.col("date_time").alias("bid_dateTime"), F.col("extra").alias("bid_extra"))
    return auction.join(b, (auction["id"] == b["auction"]) & b["bid_dateTime"].between(auction["date_time"], auction["expires"]))


def interval_join(left: DataFrame, right: DataFrame, equal: Column, left_time: str, right_time: str, within: str) -> DataFrame:
    """Rows that are equal by `equal` and at most `within` apart in time, on either side.

    On streams the caller sets watermarks; the two bounds let Spark drop state.
    """
    span = F.expr(f"INTERVAL {within}")
    near = (F.col(right_time) >= F.col(left_time) - span) & (F.col(right_time) <= F.col(left_time) + span)
    return left.join(right, equal & near)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: str, right_by: str, payload: list[str]) -> DataFrame:
    """Each left row with the right row of its keys whose right_by is the greatest at most left_by; left rows without one go.

    Both sides go through one shuffle by key: a running last value over their
    union finds the match, so that no row meets more than one partner.
    """
    tagged_left = left.withColumn("_at", F.col(left_by)).withColumn("_side", F.lit(1))
    for name in payload:
        tagged_left = tagged_left.withColumn(f"_p_{name}", F.lit(None).cast(right.schema[name].dataType))
    rest = [c for c in left.columns if c not in keys]
    tagged_right = right.select(*keys, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], F.col(right_by).alias("_at"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_p_{c}") for c in payload])
    both = tagged_left.unionByName(tagged_right)
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.struct(*[F.col(f"_p_{c}").alias(c) for c in payload])
    matched = both.withColumn("_match", F.last(F.when(F.col("_side") == 0, carried), ignorenulls=True).over(order))
    return matched.where("_side = 1 AND _match IS NOT NULL").select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in payload])


def lookup(rows: DataFrame, side: DataFrame, key: Column) -> DataFrame:
    """rows with the side table's value for a key; rows without one go.

    The planner broadcasts the side table if its size is known to be small.
    """
    return rows.join(side, key == side["key"])


def not_in(rows: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """SQL's NOT IN, with its nulls: none qualifies if the list holds a null, nor a null unless the list is empty.

    Without nulls in the list it is an anti-join on the key, which a large list
    only makes a shuffle; the list's nulls are one counted row.
    """
    key = F.col(listed_column)
    counts = listed.agg(F.struct(F.count("*").alias("n"), F.count_if(key.isNull()).alias("nulls")).alias("counts")).scalar()
    keys = listed.select(key.alias("_key")).where("_key IS NOT NULL").distinct()
    left = rows.join(keys, F.col(column) == F.col("_key"), "left_anti")
    return left.where(((counts["nulls"] == 0) & F.col(column).isNotNull()) | (counts["n"] == 0))
