"""Queries that join and group without time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstream.functions.aggregates import count_when, latest, top_k
from gavelstream.functions.scalars import day, minute
from gavelstream.operators.distinct_counts import ranked_counts
from gavelstream.operators.joins import not_in, valid_bids
from gavelstream.operators.ranking import last_row, top_overall, top_rows
from gavelstream.operators.windows import predicate_sessions
from gavelstream.sources.auction_tables import Market

#: Price ranks: below, between, and from the second bound on.
RANK_BOUNDS = (10_000, 1_000_000)


def price_ranks() -> dict:
    """The ranks' names and conditions."""
    low, high = RANK_BOUNDS
    price = F.col("price")
    return {"rank1": price < low, "rank2": (price >= low) & (price < high), "rank3": price >= high}


def q3_no_condition(market: Market) -> DataFrame:
    """Every auction with its seller."""
    joined = market.auction.join(market.person, market.auction["seller"] == market.person["id"])
    return joined.select(market.person["name"], market.person["city"], market.person["state"], market.auction["id"])


def q3(market: Market, category: int = 14, states: tuple[str, ...] = ("or", "wy", "ca")) -> DataFrame:
    """Sellers in some states with auctions of one category."""
    chosen = Market(market.person.where(F.col("state").isin(*states)), market.auction.where(F.col("category") == category), market.bid)
    return q3_no_condition(chosen)


def final_prices(market: Market) -> DataFrame:
    """id, category, final: the highest valid bid of each auction."""
    return valid_bids(market.auction, market.bid).groupBy("id", "category").agg(F.max("price").alias("final"))


def q4(market: Market) -> DataFrame:
    """Average final price by category."""
    return final_prices(market).groupBy("category").agg(F.avg("final").alias("avg_price"))


def q6(market: Market, last: int = 10) -> DataFrame:
    """After each valid bid's time, the sum of its seller's last ten highest bids per auction and time, over ten."""
    finals = valid_bids(market.auction, market.bid).groupBy("id", "seller", "bid_dateTime").agg(F.max("price").alias("final"))
    order = Window.partitionBy("seller").orderBy("bid_dateTime", "id").rowsBetween(1 - last, 0)
    return finals.select("seller", (F.sum("final").over(order) / F.lit(float(last))).alias("avg_sell_price"))


def q6_winning(market: Market, last: int = 10) -> DataFrame:
    """After each auction's end, the average final price of its seller's last ten auctions."""
    finals = valid_bids(market.auction, market.bid).groupBy("id", "seller", "expires").agg(F.max("price").alias("final"))
    order = Window.partitionBy("seller").orderBy("expires", "id").rowsBetween(1 - last, 0)
    return finals.select("id", "seller", F.avg("final").over(order).alias("avg_sell_price"))


def q9(market: Market) -> DataFrame:
    """Auctions with their winning bid: the highest, of equal ones the earliest."""
    order = [F.col("price").desc(), F.col("bid_dateTime").asc(), F.col("bidder").asc()]
    return top_rows(valid_bids(market.auction, market.bid), ["id"], order, 1)


def q9_session(market: Market, longest_seconds: int = 7200) -> DataFrame:
    """Per auction and bidding session, the best bid as an array of one.

    A session opens with a bid before the auction's end and closes with one at
    it, or with two hours of silence.
    """
    return bidding_sessions(valid_bids(market.auction, market.bid), longest_seconds)


def bidding_sessions(bids: DataFrame, longest_seconds: int = 7200) -> DataFrame:
    """q9_session from the valid bids with their auctions."""
    running, over = F.col("bid_dateTime") < F.col("expires"), F.col("bid_dateTime") >= F.col("expires")
    sessions = predicate_sessions(bids, ["id"], "bid_dateTime", running, over, longest_seconds, ["price", "bidder"])
    entry = F.struct("price", "id", "itemName", "seller")
    ends = F.max("bid_dateTime")
    grouped = sessions.groupBy("id", "session_start").agg(ends.alias("we"), F.array(F.max(entry)).alias("wb"))
    return grouped.select(F.col("session_start").alias("ws"), "we", "wb")


def _date() -> Column:
    """The day as a date, which groups faster than its text."""
    return F.to_date("date_time")


def q15(market: Market) -> DataFrame:
    """Bids, bidders and auctions per day, in all and by price rank."""
    found = ranked_counts(market.bid.withColumn("day", _date()), ["day"], {"bidders": "bidder", "auctions": "auction"}, price_ranks(), "bids")
    return found.withColumn("day", day(F.col("day")))


def q16(market: Market) -> DataFrame:
    """As q15 per channel and day, with the last minute of a bid."""
    found = ranked_counts(market.bid.withColumn("day", _date()), ["channel", "day"], {"bidders": "bidder", "auctions": "auction"}, price_ranks(), "bids", {"minute": F.col("date_time")})
    return found.withColumns({"day": day(F.col("day")), "minute": minute(F.col("minute"))})


def q17(market: Market) -> DataFrame:
    """Bids per auction and day by price rank, with least, greatest, average (whole) and total price."""
    price = F.col("price")
    found = market.bid.withColumn("day", _date()).groupBy("auction", "day").agg(
        F.count("*").alias("total_bids"),
        *[count_when(c).alias(f"{r}_bids") for r, c in price_ranks().items()],
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.expr("sum(price) div count(price)").alias("avg_price"),
        F.sum(price).alias("sum_price"),
    )
    return found.withColumn("day", day(F.col("day")))


def q18(market: Market) -> DataFrame:
    """Each bidder's last bid on each auction."""
    return last_row(market.bid, ["bidder", "auction"], [F.col("date_time").desc(), F.col("price").desc()])


def q18_latest(market: Market) -> DataFrame:
    """The auction of each bidder's last bid."""
    return market.bid.groupBy("bidder").agg(latest(F.col("auction"), F.struct("date_time", "price", "auction")).alias("auction"))


def q19(market: Market, n: int = 10) -> DataFrame:
    """Each auction's ten highest bids with their rank."""
    return top_rows(market.bid, ["auction"], [F.col("price").desc(), F.col("date_time").asc(), F.col("bidder").asc()], n, "rank_number")


def q19_topk(market: Market, n: int = 10) -> DataFrame:
    """Each auction's ten highest prices as an array."""
    return top_k(market.bid, ["auction"], "price", n).select("auction", F.col("top").alias("prices"))


def q20(market: Market, category: int = 10) -> DataFrame:
    """Bids with their auction, for one category."""
    a, b = market.auction.where(F.col("category") == category), market.bid
    return b.join(a, b["auction"] == a["id"]).select(
        "auction", "bidder", "price", "channel", "url", b["date_time"].alias("bid_dateTime"), b["extra"].alias("bid_extra"),
        "itemName", "description", "initialBid", "reserve", a["date_time"].alias("auction_dateTime"), "expires", "seller", "category",
        a["extra"].alias("auction_extra"),
    )


def q101(market: Market) -> DataFrame:
    """Auctions with their highest bid, if any."""
    highest = market.bid.groupBy("auction").agg(F.max("price").alias("max_price"))
    return market.auction.join(highest, market.auction["id"] == highest["auction"], "left").select("id", "itemName", "max_price")


def _bid_counts(market: Market) -> DataFrame:
    return market.bid.groupBy("auction").agg(F.count("*").alias("bid_count"))


def q102(market: Market) -> DataFrame:
    """Auctions with at least the average number of bids per auction that has any."""
    # without nulls, as the join would leave them out of its side alone, and group the bids once more
    counts = _bid_counts(market).where("auction IS NOT NULL")
    many = counts.where(F.col("bid_count") >= counts.agg(F.avg("bid_count").alias("n")).scalar())
    return market.auction.join(many, market.auction["id"] == many["auction"]).select("id", "itemName", "bid_count")


def q103(market: Market, least: int = 20) -> DataFrame:
    """Auctions among those with at least so many bids."""
    many = _bid_counts(market).where(F.col("bid_count") >= least)
    return market.auction.join(many, market.auction["id"] == many["auction"], "left_semi").select("id", "itemName")


def q104(market: Market, least: int = 20) -> DataFrame:
    """Auctions not among those with fewer bids than that; one without bids is in."""
    few = _bid_counts(market).where(F.col("bid_count") < least)
    return not_in(market.auction, "id", few, "auction").select("id", "itemName")


def q105(market: Market, n: int = 1000) -> DataFrame:
    """The auctions with the most bids, of equal ones the smaller id first."""
    counts = _bid_counts(market)
    joined = market.auction.join(counts, market.auction["id"] == counts["auction"]).select("id", "itemName", "bid_count")
    return top_overall(joined, [F.col("bid_count").desc(), F.col("id").asc()], n)


def q106(market: Market) -> DataFrame:
    """The lowest final price."""
    return final_prices(market).agg(F.min("final").alias("min_final"))
