"""Queries whose stream form has state of its own, run as streams over the given tables until all has come."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream import schemas
from gavelstream.plans import relational
from gavelstream.sources.auction_tables import Market, read_market
from gavelstream.sources.readers import Source
from gavelstream.streaming import queries as streams
from gavelstream.streaming.carried import AsOfTable, EndedAuctions, HottestWindows, start_carrying
from gavelstream.streaming.market import stream_market, write_market
from gavelstream.streaming.sinks import start_merging
from gavelstream.streaming.state import use_rocksdb

#: Later than everything: a last row then takes the watermark past all others.
LAST_TIME = "TIMESTAMP_NTZ'9999-01-01 00:00:00'"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: in spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"spark-{name}-")


def ended(market: Market) -> Market:
    """The market with a last auction and a last bid on no auction, of negative ids."""
    last = F.expr(LAST_TIME)
    auction = market.auction.limit(1).withColumns({"id": F.lit(-1).cast("long"), "date_time": last, "expires": last})
    bid = market.bid.limit(1).withColumns({"auction": F.lit(-2).cast("long"), "date_time": last})
    return Market(market.person, market.auction.unionByName(auction), market.bid.unionByName(bid))


#: What is made of ended auctions, and of all that came of them.
ENDED: dict[str, tuple[Callable[[Market], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "q9": (relational.q9, lambda found: found),
    "q9_session": (relational.q9_session, lambda found: found),
    # an auction that came again after its end has one final price
    "q4": (relational.final_prices, lambda found: found.groupBy("id", "category").agg(F.max("final").alias("final")).groupBy("category").agg(F.avg("final").alias("avg_price"))),
}


def _ended(market: Market, name: str, folder: str, places: dict[str, Source]) -> DataFrame:
    each, result = ENDED[name]
    table = EndedAuctions(f"{folder}/ended", each, {"auction": 4, "bid": 4})
    start_carrying(table.rows(market), table, f"{folder}/checkpoint")
    return result(table.result(market.bid.sparkSession))


def _hottest(market: Market, name: str, folder: str, places: dict[str, Source]) -> DataFrame:
    table = HottestWindows(f"{folder}/windows", "auction", slide_seconds=5, slides=60)
    last = start_carrying(table.panes(market.bid, "date_time"), table, f"{folder}/checkpoint")
    table.close(market.bid.sparkSession, last, F.expr(LAST_TIME).cast("timestamp"))
    return table.result(market.bid.sparkSession)


def _merged(market: Market, name: str, folder: str, places: dict[str, Source]) -> DataFrame:
    merged, numbers = streams.WHOLE[name], []
    table = merged.table(f"{folder}/table")
    start_merging(merged.changes(market), table, merged.partial, f"{folder}/checkpoint", lambda _, n: numbers.append(n)).awaitTermination()
    return merged.result(table.version(market.bid.sparkSession, numbers[-1]))


def _asof(market: Market, name: str, folder: str, places: dict[str, Source]) -> DataFrame:
    """Auctions at their end with the last opening of their seller until then."""
    spark = market.auction.sparkSession
    flat = places["auction"].stream(spark, schemas.auction()).selectExpr("id", "seller", "expires", "date_time AS opened")
    table = AsOfTable(f"{folder}/asof", "seller", "at", ("opened",), {"left": 10, "right": 4})
    left = flat.select("seller", F.col("expires").alias("at"), "id", "expires")
    right = flat.select("seller", F.col("opened").alias("at"), "opened")
    start_carrying(table.rows(left, right), table, f"{folder}/checkpoint")
    return table.result(spark).select("id", "seller", "expires", "opened")


Run = Callable[[Market, str, str, dict[str, Source]], DataFrame]


def _replayed(run: Run, name: str, last_row: bool, **used: str) -> Callable[[SparkSession, str], DataFrame]:
    """`used` names the tables that the query reads, with the columns that it uses besides date_time; a stream's others are null."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_rocksdb(spark)
        folder = work_folder(spark, f"stream-{name}")
        market = read_market(spark, sf_dir)
        market = ended(market) if last_row else market
        pruned = {kind: getattr(market, kind).select("date_time", *columns.split()) for kind, columns in used.items()}
        places = write_market(replace(market, **pruned), f"{folder}/in", files=3, names=tuple(used))
        found = run(stream_market(spark, **places), name, folder, places)
        # the batch forms have times without a zone
        times = [f.name for f in found.schema if f.dataType.typeName() == "timestamp"]
        return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else found

    return query


#: Name -> query over a folder of tables; what ends with the watermark gets a last row behind it.
REPLAYED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q9": _replayed(_ended, "q9", True, auction="id itemName description initialBid reserve expires seller category extra", bid="auction bidder price extra"),
    "q9_session": _replayed(_ended, "q9_session", True, auction="id itemName expires seller", bid="auction bidder price"),
    "q5_many_windows": _replayed(_hottest, "q5_many_windows", True, bid="auction"),
    "q4": _replayed(_ended, "q4", True, auction="id category expires", bid="auction price"),
    **{n: _replayed(_merged, n, False, auction="id itemName", bid="auction price") for n in ("q101", "q105")},
    "q15": _replayed(_merged, "q15", False, bid="auction bidder price"),
    "q16": _replayed(_merged, "q16", False, bid="auction bidder price channel"),
    "asof_join": _replayed(_asof, "asof_join", True, auction="id expires seller"),
}
