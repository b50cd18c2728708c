"""Every registered batch query: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.functions.aggregates import top_k
from gavelstream.functions.scalars import array_average, json_path
from gavelstream.operators.joins import asof_join, interval_join, not_in
from gavelstream.operators.ranking import last_row, top_overall
from gavelstream.operators.windows import hop, session_counts, tumble
from gavelstream.plans import relational, stateless, windowed
from gavelstream.reports import dashboard
from gavelstream.sources.auction_tables import Market, event_time, read_market, side_input, split_union, union_events
from gavelstream.sources.readers import latest_by_key, literal_rows
from gavelstream.streaming.replay import REPLAYED

Query = Callable[[SparkSession, str], DataFrame]

#: Report and case that the dashboard entries show.
REPORT, CASE = "20240102000000", "q1"


def _market(query: Callable, **parameters) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(read_market(spark, sf_dir), **parameters)

    run.__doc__ = query.__doc__
    return run


def _table(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_rows(spark)


def _union_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = split_union(union_events(read_market(spark, sf_dir)))
    return relational.q4(market)


def _union_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_time(union_events(read_market(spark, sf_dir)))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("dateTime").alias("first_time"), F.max("dateTime").alias("last_time"))


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_market(spark, sf_dir)
    a = m.auction.select("id", F.col("date_time").alias("opened"), "category")
    b = m.bid.select("auction", "price", "date_time")
    return interval_join(a, b, F.col("id") == F.col("auction"), "opened", "date_time", "2 HOURS").groupBy("category").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's last auction before each of their auctions' expiry."""
    m = read_market(spark, sf_dir)
    left = m.auction.select("seller", "id", "expires")
    right = m.auction.select("seller", F.col("date_time").alias("opened"), F.col("id").alias("last_id"))
    return asof_join(left, right, ["seller"], "expires", "opened", ["opened"])


def _not_in_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN against a list that holds a null: no rows."""
    m = read_market(spark, sf_dir)
    listed = m.bid.select(F.when(F.col("auction") % 2 == 0, F.col("auction")).alias("auction"))
    return not_in(m.auction, "id", listed, "auction").select("id")


def _filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = read_market(spark, sf_dir).bid
    cheap = F.col("price") < 10_000
    return bid.groupBy("channel").agg(F.countDistinct(F.when(cheap, F.col("bidder"))).alias("cheap_bidders"), F.count_if(cheap).alias("cheap_bids"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = read_market(spark, sf_dir).bid
    return latest_by_key(bid, "auction", F.struct("date_time", "price", "bidder")).select("auction", "bidder", "price", "date_time")


def _average_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = read_market(spark, sf_dir).bid
    first = bid.groupBy("auction").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return first.select("auction", array_average(F.array(F.col("low").cast("double"), F.col("high").cast("double"))).alias("middle"))


def _joined_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays put together from literals and from other arrays."""
    bid = read_market(spark, sf_dir).bid
    ends = bid.groupBy("auction").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    both = F.concat(F.array("low"), F.array(F.col("high"), F.lit(0).cast("long")))
    return ends.select("auction", F.size(both).alias("n"), F.element_at(both, 2).alias("second"), F.element_at(both, -1).alias("last"))


def _max_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each auction's three highest bids with who made them and when, from an array of structs."""
    top = top_k(read_market(spark, sf_dir).bid, ["auction"], "price", 3, ["date_time", "bidder"])
    return top.select("auction", F.posexplode("top").alias("place", "bid")).select("auction", "place", "bid.*")


def _bids_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = read_market(spark, sf_dir).bid.select(F.to_date("date_time").alias("day"), F.date_trunc("MINUTE", "date_time").alias("minute"))
    counted = bid.groupBy("day", "minute").agg(F.count("*").alias("n"))
    return counted.select(F.col("day").cast("string").alias("day"), F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n")


def _url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.get(F.split("url", "/"), 2).alias("host"), F.get(F.split("url", "/"), 3).alias("dir1"))


def _sinkless_report(which: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results, stats = dashboard.sample_reports(spark.read.parquet(f"{sf_dir}/events.parquet"))
        return {
            "response_time": lambda: dashboard.response_time(results, REPORT, CASE),
            "report_times": lambda: dashboard.report_times(results),
            "cases": lambda: dashboard.cases(results),
            "memory": lambda: dashboard.memory_gb(stats, REPORT, CASE),
            "cpu": lambda: dashboard.cpu_utilization(stats, REPORT, CASE),
            "network_write": lambda: dashboard.network_mb(stats, REPORT, CASE, "tx"),
            "network_read": lambda: dashboard.network_mb(stats, REPORT, CASE, "rx"),
        }[which]()

    return run


def _hourly(events: DataFrame) -> DataFrame:
    counted = events.groupBy(tumble("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("starttime"), "event_type", "n")


def _hops(events: DataFrame) -> DataFrame:
    counted = events.groupBy(hop("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "n")


def _json(events: DataFrame) -> DataFrame:
    found = events.select("event_type", json_path(F.col("props"), "k", "bigint").alias("k"))
    return found.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


#: Queries of the three tables: name -> function of the market, with their own defaults.
MARKET_QUERIES: dict[str, Callable[[Market], DataFrame]] = {
    **{f"q{k}": getattr(stateless, f"q{k}") for k in (0, 1, 2, 10, 14, 21, 22)},
    **{n: getattr(relational, n) for n in ("q3", "q3_no_condition", "q4", "q6", "q6_winning", "q9", "q9_session")},
    **{n: getattr(relational, n) for n in ("q15", "q16", "q17", "q18", "q18_latest", "q19", "q19_topk", "q20")},
    **{n: getattr(relational, n) for n in ("q101", "q102", "q103", "q104", "q105", "q106")},
    **{n: getattr(windowed, n) for n in ("q5", "q5_asof", "q5_rewrite", "q5_many_windows", "q7", "q7_rewrite", "q8", "q8_any_window", "q11", "q12")},
    "q13": lambda m: stateless.q13(m, side_input(m.bid.sparkSession)),
}

QUERIES: dict[str, Query] = {
    "base": base,
    **{n: _market(q) for n, q in MARKET_QUERIES.items()},
    # sessions' best bids one to a row, as results with arrays of structs don't compare everywhere
    "q9_session": _market(lambda m: relational.q9_session(m).select("ws", "we", F.inline("wb"))),
    # thresholds that these tables reach; the workload's own as *_20
    "q103": _market(relational.q103, least=8),
    "q104": _market(relational.q104, least=8),
    "q103_20": _market(relational.q103),
    "q104_20": _market(relational.q104),
    "q7_two_seconds": _market(windowed.q7, seconds=2),
    "union_stream_split": _union_split,
    "union_event_time": _union_times,
    "interval_join": _interval,
    "asof_join": _asof,
    "null_aware_anti_join": _not_in_null,
    "filtered_distinct": _filtered_distinct,
    "latest_by_key": _latest,
    "array_average": _average_array,
    "array_concat": _joined_arrays,
    "max_k_bids": _max_k,
    "bids_by_minute": _bids_by_minute,
    "url_segments": _url_segments,
    "tumble_events": _table("events", _hourly),
    "hop_events": _table("events", _hops),
    "session_events": _table("events", lambda e: session_counts(e, ["user_id"], "ts", "30 minutes", "n")),
    "json_path_events": _table("events", _json),
    "last_event": _table("events", lambda e: last_row(e.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])),
    "distinct_events": _table("events", lambda e: e.select("event_type").distinct()),
    "top_events": _table("events", lambda e: top_overall(e.select("event_id", "value"), [F.col("value").desc(), F.col("event_id").asc()], 100)),
    # the stream forms with state of their own, run to the end of the tables
    **{f"stream_{n}": q for n, q in REPLAYED.items()},
    "stream_q9_session": lambda spark, sf_dir: REPLAYED["q9_session"](spark, sf_dir).select("ws", "we", F.inline("wb")),
    **{f"dashboard_{n}": _sinkless_report(n) for n in ("response_time", "report_times", "cases", "memory", "cpu", "network_write", "network_read")},
}
