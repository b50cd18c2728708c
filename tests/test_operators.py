"""Edge cases of operators and functions."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gavelstream.functions.aggregates import top_k
from gavelstream.functions.scalars import array_average, count_char, euros, json_path, regex_group_or_null, register_count_char, split_index
from gavelstream.operators.joins import asof_join, interval_join, not_in
from gavelstream.operators.ranking import last_row, top_rows
from gavelstream.operators.windows import hop, hop_counts_by_pane, predicate_sessions, session_counts
from gavelstream.plans import relational, stateless, windowed
from gavelstream.sources.auction_tables import Market, create_views, read_market

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def bids(spark, rows):
    """(auction, bidder, price, seconds, channel, url)"""
    full = [(a, b, p, c, u, at(s), "abccc") for a, b, p, s, c, u in ((*r, "x", "http://h/a/b/c")[:6] for r in rows)]
    return spark.createDataFrame(full, "auction long, bidder long, price long, channel string, url string, date_time timestamp_ntz, extra string")


def auctions(spark, rows):
    """(id, seller, seconds, expires)"""
    full = [(i, f"item{i}", "d", 1, 1, at(s), at(e), v, 10, "") for i, v, s, e in rows]
    return spark.createDataFrame(full, "id long, itemName string, description string, initialBid long, reserve long, date_time timestamp_ntz, expires timestamp_ntz, seller long, category long, extra string")


def test_scalars(spark):
    df = spark.createDataFrame([("abccc", "a/b", 100, '{"a":{"b":7}}', [1.0, 3.0])], "s string, u string, p long, j string, v array<double>")
    row = df.select(
        count_char(F.col("s"), "c").alias("n"), split_index(F.col("u"), "/", 1).alias("part"), split_index(F.col("u"), "/", 3).alias("beyond"),
        regex_group_or_null(F.col("u"), "x=([^&]*)", 1).alias("none"), euros(F.col("p")).alias("euros"), json_path(F.col("j"), "a.b", "int").alias("j"),
        array_average(F.col("v")).alias("mean"), array_average(F.array().cast("array<double>")).alias("empty"),
    ).first()
    assert tuple(row) == (3, "b", None, None, Decimal("90.800"), 7, 2.0, None)
    register_count_char(spark)
    assert spark.sql("SELECT count_char('abccc', 'c') AS n").first()["n"] == 3


def test_session_boundary(spark):
    df = bids(spark, [(1, 1, 1, 0), (1, 1, 1, 10), (1, 1, 1, 20.001)])
    found = sorted(map(tuple, session_counts(df, ["bidder"], "date_time", "10 seconds", "n").select("n", "starttime", "endtime").collect()))
    assert found == [(1, at(20.001), at(30.001)), (2, at(0), at(20))]


def hop_counts(df, keys, time, size, slide):
    counted = df.groupBy(*keys, hop(time, size, slide).alias("w")).agg(F.count("*").alias("num"))
    return counted.select(*keys, F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"), "num")


def test_hop_has_five_windows(spark):
    found = hop_counts(bids(spark, [(1, 1, 1, 3)]), ["auction"], "date_time", "10 seconds", "2 seconds").collect()
    assert sorted(r["starttime"] for r in found) == [at(s) for s in (-6, -4, -2, 0, 2)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60)), min_size=1, max_size=25))
def test_panes_equal_windows(spark, rows):
    df = bids(spark, [(a, 1, 1, s) for a, s in rows])
    plain = hop_counts(df, ["auction"], "date_time", "10 seconds", "2 seconds")
    panes = hop_counts_by_pane(df, ["auction"], "date_time", 2, 5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, panes.select(*plain.columns).collect()))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_combine_before_the_shuffle_and_scan_once(spark):
    market = read_market(spark, "/root/testdata/sf0.001")
    for query in (windowed.q5, windowed.q5_many_windows, windowed.q5_rewrite, windowed.q5_asof):
        plan = executed(query(market))
        assert "REPARTITION" not in plan and "partial_count" in plan
    assert "ReusedExchange" in executed(relational.q102(market)).split("Initial Plan")[0]
    plan = executed(stateless.q21(market))
    assert "RLIKE" in plan and "Generate" not in plan


def test_q5_ties_and_asof(spark):
    market = Market(None, None, bids(spark, [(1, 1, 1, 0), (2, 1, 1, 1)]))
    rows = sorted(map(tuple, windowed.q5(market).collect()))
    assert len({r[0] for r in rows}) == 2
    assert rows == sorted(map(tuple, windowed.q5_asof(market).collect()))
    assert {tuple(r) for r in windowed.q5_rewrite(market).collect()} < set(rows)


def test_q7_window_end_is_inclusive(spark):
    market = Market(None, None, bids(spark, [(1, 1, 5, 3), (2, 2, 5, 10), (3, 3, 9, 12)]))
    assert sorted(r["auction"] for r in windowed.q7(market).collect()) == [1, 2, 3]


def test_not_in_with_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    with_null = spark.createDataFrame([(1,), (None,)], "x long")
    assert not_in(rows, "id", with_null, "x").count() == 0
    assert [r["id"] for r in not_in(rows, "id", with_null.where("x IS NOT NULL"), "x").collect()] == [2]
    assert not_in(rows, "id", with_null.where("x = 9"), "x").count() == 3


def test_q104_keeps_auctions_without_bids(spark):
    market = Market(None, auctions(spark, [(1, 1, 0, 9), (2, 1, 0, 9)]), bids(spark, [(1, 1, 1, 1)]))
    assert [r["id"] for r in relational.q104(market, 2).collect()] == [2]
    assert relational.q103(market, 2).count() == 0


def test_q14_hours(spark):
    hours = {6: "nightTime", 7: "otherTime", 8: "dayTime", 18: "dayTime", 19: "otherTime", 20: "nightTime"}
    market = Market(None, None, bids(spark, [(h, 1, 2_000_000, 3600 * h) for h in hours]))
    assert {r["auction"]: r["bidTimeType"] for r in stateless.q14(market).collect()} == hours


def test_q21_without_id_goes(spark):
    market = Market(None, None, bids(spark, [(1, 1, 1, 0, "other", "http://h/?q=1"), (2, 1, 1, 0, "APPLE", "x"), (3, 1, 1, 0, "other", "http://h/?q=1&channel_id=77")]))
    assert {r["auction"]: r["channel_id"] for r in stateless.q21(market).collect()} == {2: "0", 3: "77"}


def test_q9_is_the_max_of_its_auction(spark):
    market = Market(None, auctions(spark, [(1, 1, 0, 9)]), bids(spark, [(1, 1, 5, 1), (1, 2, 8, 2), (1, 3, 8, 3), (1, 4, 99, 10)]))
    row = relational.q9(market).first()
    assert (row["bidder"], row["price"]) == (2, 8)
    assert relational.q4(market).first()["avg_price"] == 8.0


def test_predicate_sessions(spark):
    rows = [(1, 0, False, False), (1, 1, True, False), (1, 2, False, True), (1, 3, False, False), (1, 4, True, False), (1, 10_000, True, False)]
    df = spark.createDataFrame([(k, at(s), a, b) for k, s, a, b in rows], "k long, t timestamp_ntz, a boolean, b boolean")
    found = predicate_sessions(df, ["k"], "t", F.col("a"), F.col("b"), 7200, [])
    assert sorted((r["t"], r["session_start"]) for r in found.collect()) == [(at(1), at(1)), (at(2), at(1)), (at(4), at(4)), (at(10_000), at(10_000))]


def test_ranking(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "k long, v long")
    assert sorted(map(tuple, top_rows(df, ["k"], [F.desc("v")], 2, "r").collect())) == [(1, 6, 2), (1, 7, 1), (2, 1, 1)]
    assert sorted(map(tuple, last_row(df, ["k"], [F.desc("v")]).collect())) == [(1, 7), (2, 1)]
    assert sorted(map(tuple, top_k(df, ["k"], "v", 2).collect())) == [(1, [7, 6]), (2, [1])]


def test_interval_and_asof(spark):
    left = spark.createDataFrame([(1, at(100), 3)], "k long, lt timestamp_ntz, n long")
    right = spark.createDataFrame([(1, at(40), 1), (1, at(95), 2), (1, at(200), 4)], "k2 long, rt timestamp_ntz, m long")
    joined = interval_join(left, right, F.col("k") == F.col("k2"), "lt", "rt", "1 MINUTE")
    assert sorted(r["m"] for r in joined.collect()) == [1, 2]
    matched = asof_join(left, right.withColumnRenamed("k2", "k"), ["k"], "n", "m", ["rt"])
    assert [r["rt"] for r in matched.collect()] == [at(95)]


@pytest.mark.parametrize("name", ["q15", "q16"])
def test_ranked_counts_against_plain_sql(spark, name):
    market = Market(None, None, bids(spark, [(a, b, p, s) for s, (a, b, p) in enumerate([(1, 1, 1), (1, 2, 20_000), (2, 2, 5), (2, 2, 2_000_000)])]))
    row = getattr(relational, name)(market).first()
    assert (row["total_bids"], row["rank1_bids"], row["total_bidders"], row["rank1_bidders"], row["rank2_auctions"], row["rank3_auctions"]) == (4, 2, 2, 2, 1, 1)


def test_sql_text_over_views(spark):
    create_views(Market(auctions(spark, []), auctions(spark, [(1, 1, 0, 9)]), bids(spark, [(1, 1, 5, 1), (1, 2, 8, 2)])))
    found = spark.sql("SELECT auction, max(price) AS top FROM bid WHERE price >= :low GROUP BY auction", args={"low": 5}).collect()
    assert [tuple(r) for r in found] == [(1, 8)]
