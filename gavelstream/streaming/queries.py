"""Each query of the catalogue as a stream: what it emits, in which mode, or what it merges.

Queries that Spark runs as they stand use the batch functions. Windowed ones
keep the window column, which carries the watermark. Results that end with an
auction or a window come from state with timers. Queries that update what they
have emitted (averages of maxima, ranks, distinct counts) merge their changes
into keyed tables; where state knows what changed, a batch costs what it brings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gavelstream.functions.scalars import day, minute
from gavelstream.operators.windows import hop, tumble
from gavelstream.plans import relational, stateless, windowed
from gavelstream.sources.auction_tables import Market, side_input
from gavelstream.streaming import auctions
from gavelstream.streaming.auctions import valid_bid_stream
from gavelstream.streaming.sinks import KeyedTable
from gavelstream.streaming.state import distinct_changes, pane_window_counts, top_rows_stream

def _hottest(market: Market, size: str, slide: str) -> DataFrame:
    counts = market.bid.groupBy("auction", hop("date_time", size, slide).alias("w")).agg(F.count("*").alias("num"))
    again = market.bid.groupBy("auction", hop("date_time", size, slide).alias("mw")).agg(F.count("*").alias("n"))
    most = again.groupBy("mw").agg(F.max("n").alias("maxn"))
    joined = counts.join(most, (F.col("w") == F.col("mw")) & (F.col("num") >= F.col("maxn")))
    return joined.select("auction", "num", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))


def q5(market: Market) -> DataFrame:
    return _hottest(market, "10 seconds", "2 seconds")


def q5_many_windows_counts(market: Market, slide_seconds: int = 5, slides: int = 60) -> DataFrame:
    """The counts of all auctions in a window, in the micro-batch that closes it."""
    return pane_window_counts(market.bid, "auction", "date_time", slide_seconds, slides)


def q7(market: Market, size: str = "10 seconds") -> DataFrame:
    highest = market.bid.groupBy(tumble("date_time", size).alias("w")).agg(F.max("price").alias("maxprice"))
    inside = F.col("date_time").between(F.col("w.start"), F.col("w.end"))
    return market.bid.join(highest, (F.col("price") == F.col("maxprice")) & inside).select("auction", "price", "bidder", "date_time", "extra")


def q8(market: Market, size: str = "10 seconds") -> DataFrame:
    persons = market.person.groupBy("id", "name", tumble("date_time", size).alias("w")).agg(F.count("*").alias("n"))
    sellers = market.auction.groupBy("seller", tumble("date_time", size).alias("sw")).agg(F.count("*").alias("m"))
    return persons.join(sellers, (F.col("id") == F.col("seller")) & (F.col("w") == F.col("sw"))).select("id", "name", F.col("w.start").alias("starttime"))


def q11(market: Market, gap: str = "10 seconds") -> DataFrame:
    counted = market.bid.groupBy("bidder", F.session_window("date_time", gap).alias("w")).agg(F.count("*").alias("bid_count"))
    return counted.select("bidder", "bid_count", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))


def q13(market: Market) -> DataFrame:
    return stateless.q13(market, side_input(market.bid.sparkSession))


def q18(market: Market) -> DataFrame:
    """Each bidder's last bid on each auction so far."""
    rest = F.struct("price", "channel", "url", "extra")
    return market.bid.groupBy("bidder", "auction").agg(F.max_by(F.struct("date_time", rest.alias("r")), F.struct("date_time", "price")).alias("b")).select("bidder", "auction", "b.date_time", "b.r.*")


def q8_any_window(market: Market, size: str = "10 seconds") -> DataFrame:
    persons = market.person.groupBy("id", "name", tumble("date_time", size).alias("w")).agg(F.count("*").alias("n"))
    sellers = market.auction.groupBy("seller", tumble("date_time", size).alias("sw")).agg(F.count("*").alias("m"))
    return persons.join(sellers, F.col("id") == F.col("seller")).select("id", "name", F.col("w.start").alias("starttime"), F.col("sw.start").alias("auction_starttime"))


def q19(market: Market) -> DataFrame:
    """A change log of each auction's ten highest bids."""
    return top_rows_stream(market.bid, "auction", ["price", "date_time", "bidder"], [False, True, True], 10, "update")


@dataclass(frozen=True)
class Merged:
    """A query over a keyed table: the changes, how a batch is reduced and merged, and the result from the table."""

    changes: Callable[[Market], DataFrame]
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[], tuple[Column, ...]]
    result: Callable[[DataFrame], DataFrame]

    def table(self, folder: str) -> KeyedTable:
        return KeyedTable(folder, self.keys, self.merge())


def _final(result: Callable[[DataFrame], DataFrame]) -> Merged:
    keys = ("id", "category")
    return Merged(valid_bid_stream, keys, lambda b: b.groupBy(*keys).agg(F.max("price").alias("final")), lambda: (F.max("final").alias("final"),), result)


def _best(columns: Column, *order: Column) -> tuple[Column, Column]:
    """The row that comes first, from a batch's rows and from the rows found so far."""
    first = F.struct(*order)
    return F.max_by(columns, first).alias("best"), F.max(first).alias("first")


def _first_rows(changes: Callable[[Market], DataFrame], keys: tuple[str, ...], order: Callable[[], tuple[Column, ...]], prepare: Callable[[DataFrame], DataFrame] = lambda b: b, columns: tuple[str, ...] = ("*",)) -> Merged:
    """The first row of each key in the falling order."""
    return Merged(
        changes,
        keys,
        lambda b: prepare(b).groupBy(*keys).agg(*_best(F.struct(*columns), *order())),
        lambda: (F.max_by("best", "first").alias("best"), F.max("first").alias("first")),
        lambda t: t.select("best.*"),
    )


def _counted(result: Callable[[DataFrame], DataFrame]) -> Merged:
    """A query over id, opened, itemName, bid_count and max_price of each auction (q101 to q105).

    A batch adds its counts to those of the table. An auction that is not known
    yet has a row, but is not opened.
    """
    added = lambda: (F.max("opened").alias("opened"), F.max("itemName").alias("itemName"), F.sum("bid_count").alias("bid_count"), F.max("max_price").alias("max_price"))
    return Merged(auctions.bid_changes, ("id",), lambda b: b.groupBy("id").agg(*added()), added, result)


def _average(table: DataFrame) -> Column:
    """Bids of an auction that has any, on average."""
    return table.where("bid_count > 0").agg(F.avg("bid_count").alias("n")).scalar()


def _distinct(keys: dict[str, Callable[[], Column]], with_minute: bool) -> Merged:
    """Distinct counts, kept up by what each batch adds to them; the ids seen are in state, until the day is over."""
    ids = {"bidders": "bidder", "auctions": "auction"}
    flags = ("total", "rank1", "rank2", "rank3")
    counts = tuple(f"{f}_{what}" for what in ("bids", *ids) for f in flags)

    def changes(market: Market) -> DataFrame:
        conditions = {"total": F.lit(True), **relational.price_ranks()}
        return distinct_changes(market.bid, "date_time", {k: column() for k, column in keys.items()}, ids, conditions)

    def partial(batch: DataFrame) -> DataFrame:
        of = lambda kind, column: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))
        added = [of("bidders", f"n_{f}").alias(f"{f}_bids") for f in flags] + [of(kind, f"new_{f}").alias(f"{f}_{kind}") for kind in ids for f in flags]
        return batch.groupBy(*keys).agg(F.max("latest").alias("latest"), *added)

    def result(table: DataFrame) -> DataFrame:
        return table.select(*keys, *([minute(F.col("latest")).alias("minute")] if with_minute else []), *counts)

    return Merged(changes, tuple(keys), partial, lambda: (F.max("latest").alias("latest"), *[F.sum(c).alias(c) for c in counts]), result)


def _average_price() -> Merged:
    """q4 from the rises of auctions' prices: the old value is taken out of its category's sum, the new one put in."""

    def partial(batch: DataFrame) -> DataFrame:
        total = F.sum(F.col("new") - F.coalesce("old", F.lit(0)))
        return batch.groupBy("category").agg(total.alias("total"), F.count_if(F.col("old").isNull()).alias("n"))

    sums = lambda: (F.sum("total").alias("total"), F.sum("n").alias("n"))
    return Merged(auctions.final_price_changes, ("category",), partial, sums, lambda t: t.select("category", (F.col("total") / F.col("n")).alias("avg_price")))


def _ids_seen(keys: dict[str, Callable[[], Column]], with_minute: bool) -> Merged:
    """_distinct over a table of the ids themselves: a row for each key and id, with the flags under which it has been seen.

    A batch is grouped before it is merged, and nothing calls Python for each
    key and day, but the ids stay in the table when their day is over.
    """
    ids = {"bidders": "bidder", "auctions": "auction"}
    flags = ("total", "rank1", "rank2", "rank3")
    names = [f"n_{f}" for f in flags]

    def partial(batch: DataFrame) -> DataFrame:
        conditions = {"total": F.lit(True), **relational.price_ranks()}
        one = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id")) for kind, c in ids.items()]))
        counts = [F.when(c, 1).otherwise(0).alias(f"n_{f}") for f, c in conditions.items()]
        placed = batch.select(*[column().alias(k) for k, column in keys.items()], "date_time", *counts, one.alias("one")).select("*", "one.*")
        return placed.groupBy(*keys, "kind", "id").agg(F.max("date_time").alias("latest"), *[F.sum(n).alias(n) for n in names])

    def result(table: DataFrame) -> DataFrame:
        of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
        seen = lambda n: F.when((F.col(n) > 0) & F.col("id").isNotNull(), 1).otherwise(0)
        counts = [of("bidders", F.col(f"n_{f}")).alias(f"{f}_bids") for f in flags] + [of(kind, seen(f"n_{f}")).alias(f"{f}_{kind}") for kind in ids for f in flags]
        last = [F.max("latest").alias("minute")] if with_minute else []
        found = table.groupBy(*keys).agg(*last, *counts).withColumn("day", day(F.col("day")))
        return found.withColumn("minute", minute(F.col("minute"))) if with_minute else found

    merge = lambda: (F.max("latest").alias("latest"), *[F.sum(n).alias(n) for n in names])
    return Merged(lambda m: m.bid, (*keys, "kind", "id"), partial, merge, result)


def change_log(merged: Merged, folder: str) -> Callable[[DataFrame, int], None]:
    """What a merging writer does after each batch to log the results that the batch changed, under the batch's number.

    A batch that runs again writes its part of the log again.
    """

    def one(table: DataFrame, number: int) -> None:
        result = merged.result(table)
        if number:
            before = merged.result(merged.table(folder).version(table.sparkSession, number - 1, table.schema))
            result = result.exceptAll(before)
        result.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/log/{number}")

    return one


def _last_prices(keys: tuple[str, ...], result: Callable[[DataFrame], DataFrame]) -> Merged:
    """A query over the highest valid bids by some keys."""
    return Merged(valid_bid_stream, keys, lambda b: b.groupBy(*keys).agg(F.max("price").alias("final")), lambda: (F.max("final").alias("final"),), result)


def _last_ten(table: DataFrame, by: str) -> WindowSpec:
    return Window.partitionBy("seller").orderBy(by, "id").rowsBetween(-9, 0)


def _window_counts(result: Callable[[DataFrame], DataFrame]) -> Merged:
    """A query over the bids of each auction in each hopping window."""

    def partial(batch: DataFrame) -> DataFrame:
        counts = batch.groupBy("auction", hop("date_time", "10 seconds", "2 seconds").alias("w")).agg(F.count("*").alias("num"))
        return counts.select("auction", F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "num")

    return Merged(lambda m: m.bid, ("auction", "starttime", "endtime"), partial, lambda: (F.sum("num").alias("num"),), result)


def _top_prices(n: int = 10) -> Merged:
    """Each auction's highest prices; a key's state is at most n numbers a run."""
    highest = lambda prices: F.slice(F.sort_array(prices, asc=False), 1, n).alias("prices")

    def partial(batch: DataFrame) -> DataFrame:
        kept = relational.top_rows(batch.select("auction", "price"), ["auction"], [F.col("price").desc()], n)
        return kept.groupBy("auction").agg(highest(F.collect_list("price")))

    return Merged(lambda m: m.bid, ("auction",), partial, lambda: (highest(F.flatten(F.collect_list("prices"))),), lambda t: t)


#: Queries that stream as they are: name -> (function of the market, output mode).
DIRECT: dict[str, tuple[Callable[[Market], DataFrame], str]] = {
    **{f"q{k}": (getattr(stateless, f"q{k}"), "append") for k in (0, 1, 2, 10, 14, 21, 22)},
    "q3": (relational.q3, "append"),
    "q3_no_condition": (relational.q3_no_condition, "append"),
    "q5": (q5, "append"),
    "q7": (q7, "append"),
    "q8": (q8, "append"),
    "q8_any_window": (q8_any_window, "append"),
    "q11": (q11, "append"),
    "q12": (windowed.q12, "update"),
    "q13": (q13, "append"),
    "q17": (relational.q17, "update"),
    "q18": (q18, "update"),
    "q18_latest": (relational.q18_latest, "update"),
    "q19": (q19, "update"),
    "q20": (relational.q20, "append"),
    "q9": (auctions.winning_bids, "append"),
    "q9_session": (auctions.bidding_sessions, "append"),
}

#: Streams whose result is a function of each micro-batch: name -> (function of the market, function of a micro-batch).
PER_BATCH: dict[str, tuple[Callable[[Market], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "q5_many_windows": (q5_many_windows_counts, windowed.hottest),
}

#: Queries over a keyed table that micro-batches are merged into.
MERGED: dict[str, Merged] = {
    "q4": _average_price(),
    "q106": _final(lambda t: t.agg(F.min("final").alias("min_final"))),
    "q6": _last_prices(("id", "seller", "bid_dateTime"), lambda t: t.select("seller", (F.sum("final").over(_last_ten(t, "bid_dateTime")) / F.lit(10.0)).alias("avg_sell_price"))),
    "q6_winning": _last_prices(("id", "seller", "expires"), lambda t: t.select("id", "seller", F.avg("final").over(_last_ten(t, "expires")).alias("avg_sell_price"))),
    "q15": _distinct({"day": lambda: day(F.col("date_time"))}, False),
    "q16": _distinct({"channel": lambda: F.col("channel"), "day": lambda: day(F.col("date_time"))}, True),
    "q19_topk": _top_prices(),
    "q101": _counted(lambda t: t.where("opened").select("id", "itemName", "max_price")),
    "q102": _counted(lambda t: t.where("opened AND bid_count > 0").where(F.col("bid_count") >= _average(t)).select("id", "itemName", "bid_count")),
    "q103": _counted(lambda t: t.where("opened").where("bid_count >= 20").select("id", "itemName")),
    "q104": _counted(lambda t: t.where("opened").where("bid_count = 0 OR bid_count >= 20").select("id", "itemName")),
    "q105": _counted(lambda t: relational.top_overall(t.where("opened AND bid_count > 0").select("id", "itemName", "bid_count"), [F.desc("bid_count"), F.asc("id")], 1000)),
    "q5_rewrite": _window_counts(lambda t: relational.top_rows(t, ["starttime", "endtime"], [F.col("num").desc(), F.col("auction").asc()], 1).select("auction", "num", "starttime", "endtime")),
    "q5_asof": _window_counts(windowed.hottest_asof),
    "q7_rewrite": _first_rows(
        lambda m: m.bid,
        ("endtime",),
        lambda: (F.col("price"), -F.unix_micros("date_time"), -F.col("auction"), -F.col("bidder")),
        lambda b: b.withColumn("endtime", tumble("date_time", "10 minutes").getField("end")),
        ("auction", "price", "bidder", "date_time", "extra"),
    ),
}

#: MERGED as the registered queries run it over whole tables, where a call of Python for each key would take the time.
WHOLE: dict[str, Merged] = MERGED | {
    "q4": _final(lambda t: t.groupBy("category").agg(F.avg("final").alias("avg_price"))),
    "q15": _ids_seen({"day": lambda: F.to_date("date_time")}, False),
    "q16": _ids_seen({"channel": lambda: F.col("channel"), "day": lambda: F.to_date("date_time")}, True),
}
