"""Person, auction and bid tables derived from the star schema's customer, orders and lineitem.

Event times follow from keys, as order dates are days. Each block of 500
auctions, with its 50 persons, lies seven hours after the one before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_START = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
_AUCTION_MS = "(o_orderkey * 100 + (o_orderkey - o_orderkey % 500) * 50400)"
_BID_MS = (
    "(l_orderkey * 100 + (l_orderkey - l_orderkey % 500) * 50400 + (l_linenumber - 1) * 900"
    " + (cast(l_partkey AS bigint) * 31 + l_suppkey) % 900)"
)


def _at(ms: str) -> str:
    return f"timestampadd(MICROSECOND, cast({ms} AS bigint) * 1000, {_START})"


@dataclass(frozen=True)
class Market:
    """The three tables that every query reads."""

    person: DataFrame
    auction: DataFrame
    bid: DataFrame


def person(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "cast(c_custkey AS bigint) AS id",
        "c_name AS name",
        "concat(lower(c_mktsegment), '@example.com') AS emailAddress",
        "lpad(cast(c_custkey AS string), 16, '0') AS creditCard",
        "concat('city_', c_nationkey) AS city",
        "element_at(array('or', 'wy', 'ca', 'id', 'az'), cast(c_nationkey % 5 + 1 AS int)) AS state",
        f"{_at('c_custkey * 1000 + (c_custkey - c_custkey % 50) * 504000')} AS date_time",
        "c_mktsegment AS extra",
    )


def auction(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey AS bigint) AS id",
        "concat('item_', o_orderkey % 997) AS itemName",
        "o_orderpriority AS description",
        "1L AS initialBid",
        "cast(o_orderkey % 1000 AS bigint) AS reserve",
        f"{_at(_AUCTION_MS)} AS date_time",
        f"{_at(f'{_AUCTION_MS} + 2000 + (o_custkey % 7) * 1000')} AS expires",
        "cast(o_custkey AS bigint) AS seller",
        "cast(10 + o_orderkey % 5 AS bigint) AS category",
        "o_orderstatus AS extra",
    )


def bid(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "cast(l_orderkey AS bigint) AS auction",
        "cast(l_suppkey AS bigint) AS bidder",
        "cast(round(l_extendedprice * CASE l_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END) AS bigint) AS price",
        "CASE l_partkey % 6 WHEN 0 THEN 'Apple' WHEN 1 THEN 'Google' WHEN 2 THEN 'Facebook' WHEN 3 THEN 'Baidu'"
        " ELSE concat('channel-', l_partkey % 100) END AS channel",
        "concat('https://www.example.com/d', l_partkey % 7, '/e', l_suppkey % 5, '/f/item.htm?query=1',"
        " CASE WHEN l_partkey % 2 = 0 THEN concat('&channel_id=', l_partkey) ELSE '' END) AS url",
        f"{_at(_BID_MS)} AS date_time",
        "concat(l_returnflag, l_linestatus, 'ccc') AS extra",
    )


def read_market(spark: SparkSession, sf_dir: str) -> Market:
    """The tables below sf_dir; only the columns that a query uses are read."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    return Market(person(table("customer")), auction(table("orders")), bid(table("lineitem")))


def create_views(market: Market) -> None:
    """The tables as temporary views person, auction and bid, for queries in SQL text."""
    for name in ("person", "auction", "bid"):
        getattr(market, name).createOrReplaceTempView(name)


def side_input(spark: SparkSession, keys: int = 10000) -> DataFrame:
    """The bounded table that bids are enriched from: key, value."""
    return spark.range(keys).select(F.col("id").alias("key"), F.concat(F.lit("v"), F.col("id")).alias("value"))


def union_events(market: Market) -> DataFrame:
    """All three tables as one tagged-union table."""
    parts = []
    for tag, name in enumerate(("person", "auction", "bid")):
        table = getattr(market, name)
        structs = [
            F.struct("*").alias(other) if other == name else F.lit(None).cast(getattr(market, other).schema).alias(other)
            for other in ("person", "auction", "bid")
        ]
        parts.append(table.select(F.lit(tag).alias("event_type"), *structs))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def event_time(events: DataFrame) -> DataFrame:
    """events with dateTime, the event time of whichever kind the tag names."""
    times = F.when(F.col("event_type") == 0, F.col("person.date_time")).when(F.col("event_type") == 1, F.col("auction.date_time"))
    return events.withColumn("dateTime", times.otherwise(F.col("bid.date_time")))


def split_union(events: DataFrame) -> Market:
    """The three tables of a tagged-union table."""
    kinds = [events.where(F.col("event_type") == tag).select(f"{name}.*") for tag, name in enumerate(("person", "auction", "bid"))]
    return Market(*kinds)
