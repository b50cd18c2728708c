"""Queries that look at one bid at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstream.functions.scalars import count_char, day, euros, minute, regex_group_or_null, split_index
from gavelstream.operators.joins import lookup
from gavelstream.sources.auction_tables import Market

#: Channels with an id of their own, and the place of the id in other channels' URLs.
CHANNEL_IDS = {"apple": "0", "google": "1", "facebook": "2", "baidu": "3"}
CHANNEL_PATTERN = "(&|^)channel_id=([^&]*)"


def q0(market: Market) -> DataFrame:
    """Bids as they are."""
    return market.bid.select("auction", "bidder", "price", "date_time", "extra")


def q1(market: Market) -> DataFrame:
    """Bids in euros."""
    return market.bid.select("auction", "bidder", euros(F.col("price")).alias("price"), "date_time", "extra")


def q2(market: Market, divisor: int = 123) -> DataFrame:
    """Bids on every so many auctions."""
    return market.bid.where(F.col("auction") % divisor == 0).select("auction", "price")


def q10(market: Market) -> DataFrame:
    """Bids with the partitions, day and minute, that a file sink lays them out by."""
    return market.bid.select("auction", "bidder", "price", "date_time", "extra", day(F.col("date_time")).alias("dt"), minute(F.col("date_time")).alias("hm"))


def q13(market: Market, side: DataFrame, keys: int = 10000) -> DataFrame:
    """Bids with the side table's value for their auction."""
    return lookup(market.bid, side, F.col("auction") % keys).select("auction", "bidder", "price", "date_time", "value")


def q14(market: Market, low: int = 1_000_000, high: int = 50_000_000) -> DataFrame:
    """Bids in a price range in euros, with the time of day and how many c their extra has."""
    hour = F.hour("date_time")
    time = F.when(hour.between(8, 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    priced = market.bid.withColumn("price", euros(F.col("price"))).where((F.col("price") > low) & (F.col("price") < high))
    return priced.select("auction", "bidder", "price", time.alias("bidTimeType"), "date_time", "extra", count_char(F.col("extra"), "c").alias("c_counts"))


def q21(market: Market) -> DataFrame:
    """Bids with their channel's id, from its name or else from the URL; bids with neither go."""
    name = F.lower("channel")
    ids = regex_group_or_null(F.col("url"), CHANNEL_PATTERN, 2)
    for channel, number in CHANNEL_IDS.items():
        ids = F.when(name == channel, number).otherwise(ids)
    known = name.isin(*CHANNEL_IDS) | F.col("url").rlike(CHANNEL_PATTERN)
    return market.bid.where(known).select("auction", "bidder", "price", "channel", ids.alias("channel_id"))


def q22(market: Market) -> DataFrame:
    """Bids with the first three directories of their URL."""
    parts = [split_index(F.col("url"), "/", k).alias(f"dir{k - 2}") for k in (3, 4, 5)]
    return market.bid.select("auction", "bidder", "price", "channel", *parts)
