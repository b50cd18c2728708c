"""Queries over time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.operators.joins import asof_join
from gavelstream.operators.ranking import top_rows
from gavelstream.operators.windows import hop_counts_by_pane, hottest_by_pane, pane_counts, session_counts, tumble, tumbles_touched
from gavelstream.sources.auction_tables import Market


def hottest(counts: DataFrame) -> DataFrame:
    """Of the counts, those that no other of their window exceeds; each task ranks its own before the shuffle."""
    order = Window.partitionBy("starttime", "endtime").orderBy(F.col("num").desc())
    return counts.withColumn("place", F.rank().over(order)).where("place = 1").select("auction", "num", "starttime", "endtime")


def q5(market: Market, slide_seconds: int = 2, slides: int = 5) -> DataFrame:
    """The auctions with the most bids in each window of ten seconds, every two seconds; ties all stay."""
    return hottest_by_pane(pane_counts(market.bid, ["auction"], "date_time", slide_seconds), "auction", slide_seconds, slides)


def _bid_counts(market: Market, slide_seconds: int = 2, slides: int = 5) -> DataFrame:
    """auction, starttime, endtime, num: bids in each hopping window, counted by pane."""
    return hop_counts_by_pane(market.bid, ["auction"], "date_time", slide_seconds, slides)


def q5_many_windows(market: Market, slide_seconds: int = 5, slides: int = 60) -> DataFrame:
    """q5 for windows of five minutes every five seconds."""
    return q5(market, slide_seconds, slides)


def q5_rewrite(market: Market) -> DataFrame:
    """One of the auctions with the most bids in each window, the smallest id."""
    return top_rows(_bid_counts(market), ["starttime", "endtime"], [F.col("num").desc(), F.col("auction").asc()], 1).select("auction", "num", "starttime", "endtime")


def q5_asof(market: Market) -> DataFrame:
    """q5 by an as-of join: counts meet the greatest maximum of their window that they reach."""
    return hottest_asof(_bid_counts(market))


def hottest_asof(counts: DataFrame) -> DataFrame:
    most = counts.groupBy("starttime").agg(F.max("num").alias("maxn"))
    return asof_join(counts, most, ["starttime"], "num", "maxn", ["maxn"]).select("auction", "num", "starttime", "endtime")


def q7(market: Market, seconds: int = 10) -> DataFrame:
    """Bids that equal the highest price of a tumbling window whose interval, ends included, holds them."""
    highest = market.bid.groupBy(tumble("date_time", f"{seconds} seconds").alias("w")).agg(F.max("price").alias("maxprice"))
    highest = highest.select(F.col("w.start").alias("starttime"), "maxprice")
    placed = market.bid.select("auction", "price", "bidder", "date_time", "extra", F.explode(tumbles_touched("date_time", seconds)).alias("starttime"))
    return placed.join(highest, (placed["starttime"] == highest["starttime"]) & (placed["price"] == highest["maxprice"])).select("auction", "price", "bidder", "date_time", "extra")


def q7_rewrite(market: Market, size: str = "10 minutes") -> DataFrame:
    """The highest bid of each ten minutes, of equal ones the earliest."""
    placed = market.bid.withColumn("endtime", tumble("date_time", size).getField("end"))
    order = [F.col("price").desc(), F.col("date_time").asc(), F.col("auction").asc(), F.col("bidder").asc()]
    return top_rows(placed, ["endtime"], order, 1).select("auction", "price", "bidder", "date_time", "extra")


def _arrivals(market: Market, size: str) -> tuple[DataFrame, DataFrame]:
    """Persons by window of arrival, and sellers by window of an auction, each once."""
    persons = market.person.groupBy("id", "name", tumble("date_time", size).alias("w")).agg(F.count("*").alias("n"))
    sellers = market.auction.groupBy("seller", tumble("date_time", size).alias("w")).agg(F.count("*").alias("n"))
    ends = [F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime")]
    return persons.select("id", "name", *ends), sellers.select("seller", *ends)


def q8(market: Market, size: str = "10 seconds") -> DataFrame:
    """Persons who opened an auction in the window in which they arrived."""
    persons, sellers = _arrivals(market, size)
    same = (persons["id"] == sellers["seller"]) & (persons["starttime"] == sellers["starttime"]) & (persons["endtime"] == sellers["endtime"])
    return persons.join(sellers, same).select("id", "name", persons["starttime"])


def q8_any_window(market: Market, size: str = "10 seconds") -> DataFrame:
    """Persons with each window in which they opened an auction, whenever they arrived."""
    persons, sellers = _arrivals(market, size)
    return persons.join(sellers, persons["id"] == sellers["seller"]).select("id", "name", persons["starttime"], sellers["starttime"].alias("auction_starttime"))


def q11(market: Market, gap: str = "10 seconds") -> DataFrame:
    """Bids per bidder and session."""
    return session_counts(market.bid, ["bidder"], "date_time", gap, "bid_count")


def q12(market: Market, size: str = "10 seconds") -> DataFrame:
    """Bids per bidder and window of processing time."""
    seen = market.bid.select("bidder", F.current_timestamp().alias("p_time"))
    counted = seen.groupBy("bidder", tumble("p_time", size).alias("w")).agg(F.count("*").alias("bid_count"))
    return counted.select("bidder", "bid_count", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))
