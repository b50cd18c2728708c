"""The stream forms that run over whole tables, and the steps that they share."""

import random

import pytest
from pyspark.sql import functions as F
from test_state import closed, rows, with_nulls

from gavelstream.operators.windows import hop_counts_by_pane, hottest_by_pane, pane_counts, predicate_sessions
from gavelstream.plans import windowed
from gavelstream.plans.catalogue import MARKET_QUERIES, QUERIES
from gavelstream.sources.auction_tables import read_market
from gavelstream.streaming import auctions, market
from gavelstream.streaming import queries as streams
from gavelstream.streaming.market import stream_market, write_market
from gavelstream.streaming.sinks import start, start_merging

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nulls(spark):
    return with_nulls(read_market(spark, SF_DIR))


@pytest.fixture(scope="module")
def places(spark, nulls, tmp_path_factory):
    return write_market(closed(nulls), str(tmp_path_factory.mktemp("market")), files=3, names=("auction", "bid"))


@pytest.mark.parametrize("tied", [False, True])
def test_a_large_part_is_many_files_and_one_batch(spark, nulls, tmp_path, monkeypatch, tied):
    monkeypatch.setattr(market, "FILE_ROWS", 400)
    table = nulls.bid.withColumn("date_time", F.when(F.col("auction") < 1200, F.expr("TIMESTAMP_NTZ'2024-01-01'")).otherwise(F.col("date_time"))) if tied else nulls.bid
    written = write_market(type(nulls)(None, None, table), str(tmp_path / "in"), files=3, names=("bid",))
    tasks = int(written["bid"].options["maxFilesPerTrigger"])
    assert tasks > 3
    seen = []
    stream = stream_market(spark, **written).bid.writeStream.foreachBatch(lambda b, n: seen.append(tuple(b.agg(F.count("*"), F.min("date_time"), F.max("date_time")).first())))
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    full = [s for s in seen if s[0]]
    assert sum(s[0] for s in full) == table.count()
    assert all(a[2] < b[1] for a, b in zip(full, full[1:]))  # a batch has its part whole


@pytest.mark.parametrize("name,form", [("q9", auctions.winning_bids_joined), ("q9_session", auctions.bidding_sessions_joined)])
def test_joined_forms_equal_batch_without_python(spark, nulls, places, tmp_path, name, form):
    found = form(stream_market(spark, **places))
    assert "TransformWithState" not in found._jdf.queryExecution().logical().toString()
    start(found, str(tmp_path / "c"), "append", "memory", name=f"joined_{name}").awaitTermination()
    assert rows(spark.table(f"joined_{name}")) == rows(MARKET_QUERIES[name](nulls))


@pytest.mark.parametrize("name", ["q4", "q15", "q16"])
def test_whole_tables_equal_batch_with_nulls(spark, nulls, places, tmp_path, name):
    merged, last = streams.WHOLE[name], []
    table = merged.table(str(tmp_path / "table"))
    changes = merged.changes(stream_market(spark, **places))
    assert "TransformWithState" not in changes._jdf.queryExecution().logical().toString()
    start_merging(changes, table, merged.partial, str(tmp_path / "c"), lambda _, n: last.append(n)).awaitTermination()
    assert rows(merged.result(table.version(spark, last[-1]))) == rows(MARKET_QUERIES[name](closed(nulls)))


@pytest.mark.parametrize("name", ["q5_many_windows", "asof_join"])
def test_carried_tables_equal_batch(spark, name):
    assert rows(QUERIES[f"stream_{name}"](spark, SF_DIR)) == rows(QUERIES[name](spark, SF_DIR))


def test_hottest_windows_without_listing_each_keys_windows(spark):
    rng = random.Random(4)
    made = [(rng.choice([1, 2, 3, 4, None]), rng.randrange(-400, 400)) for _ in range(150)]
    df = spark.createDataFrame(made, "k int, s int").select("k", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("t"))
    for slide, slides in ((2, 5), (5, 12), (7, 1)):
        want = windowed.hottest(hop_counts_by_pane(df.withColumnRenamed("k", "auction"), ["auction"], "t", slide, slides))
        panes = pane_counts(df.withColumnRenamed("k", "auction"), ["auction"], "t", slide)
        assert rows(hottest_by_pane(panes, "auction", slide, slides)) == rows(want)
        cut = F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + INTERVAL '{slide * 9}' SECOND")
        parts = hottest_by_pane(panes, "auction", slide, slides, None, cut).unionByName(hottest_by_pane(panes, "auction", slide, slides, cut))
        assert rows(parts) == rows(want)


def test_sessions_take_one_sort(spark):
    made = [(k % 5, k * 37 % 101, k % 7 < 3, k % 11 == 0, k) for k in range(300)]
    df = spark.createDataFrame(made, "k int, s int, a boolean, b boolean, n int").select("k", F.timestamp_seconds("s").alias("t"), "a", "b", "n")
    found = predicate_sessions(df, ["k"], "t", F.col("a"), F.col("b"), 3, ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    want = []
    for k in range(5):
        opened, before = None, None
        for _, t, a, b, n in sorted((r for r in made if r[0] == k), key=lambda r: (r[1], r[4])):
            if before is not None and t - before > 3:
                opened = None
            before = t
            opened = t if opened is None and a else opened
            if opened is not None:
                want.append((n, opened))
            if b:
                opened = None
    got = [(r["n"], r["s"]) for r in found.select("n", F.unix_seconds("session_start").alias("s")).collect()]
    assert sorted(got) == sorted(want)
