"""Streams against their batch twins, and the sinks."""

import pytest
from pyspark.sql import functions as F

from gavelstream import schemas
from gavelstream.plans import stateless
from gavelstream.plans.catalogue import MARKET_QUERIES, QUERIES
from gavelstream.sources.auction_tables import read_market, side_input, union_events
from gavelstream.sources.readers import Source
from gavelstream.streaming import queries as streams
from gavelstream.streaming.market import stream_market, stream_union, write_market
from gavelstream.streaming.sinks import KeyedTable, start, start_merging, start_partitioned, upsert_messages

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    return write_market(read_market(spark, SF_DIR), str(tmp_path_factory.mktemp("market")), files=2)


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(columns).collect())


def streamed(spark, places, tmp_path, name, mode=None):
    query, own_mode = streams.DIRECT[name]
    table = f"out_{name}"
    start(query(stream_market(spark, **places)), str(tmp_path / "checkpoint"), mode or own_mode, "memory", name=table).awaitTermination()
    return spark.table(table)


@pytest.mark.parametrize("name", ["q0", "q1", "q2", "q10", "q13", "q14", "q21", "q22", "q3", "q3_no_condition", "q20"])
def test_unwindowed_streams_equal_batch(spark, places, tmp_path, name):
    assert rows(streamed(spark, places, tmp_path, name)) == rows(QUERIES[name](spark, SF_DIR))


def test_bids_meet_a_bounded_csv_side(spark, places, tmp_path):
    side_input(spark).write.csv(str(tmp_path / "side"))
    side = Source("csv", str(tmp_path / "side")).read(spark, schemas.SIDE_INPUT)
    enriched = stateless.q13(stream_market(spark, **places), side)
    start(enriched, str(tmp_path / "checkpoint"), "append", "memory", name="out_csv_side").awaitTermination()
    assert rows(spark.table("out_csv_side")) == rows(QUERIES["q13"](spark, SF_DIR))


@pytest.mark.parametrize("name,least", [("q5", 150), ("q7", 16), ("q8", 55), ("q8_any_window", 60), ("q11", 15)])
def test_windowed_streams_emit_the_closed_windows(spark, places, tmp_path, name, least):
    got, want = rows(streamed(spark, places, tmp_path, name)), rows(QUERIES[name](spark, SF_DIR))
    assert set(got) <= set(want) and len(got) >= least


@pytest.mark.parametrize("name,keys", [("q17", ["auction", "day"]), ("q18", ["bidder", "auction"]), ("q18_latest", ["bidder"])])
def test_updates_end_at_the_batch_result(spark, places, tmp_path, name, keys):
    changes = streamed(spark, places, tmp_path, name)
    want = QUERIES[name](spark, SF_DIR)
    assert set(rows(want)) <= set(rows(changes))
    assert changes.select(keys).distinct().count() == want.count()


def test_windows_of_processing_time_count_each_bid_once(spark, places, tmp_path):
    changes = streamed(spark, places, tmp_path, "q12")
    last = changes.groupBy("bidder", "starttime", "endtime").agg(F.max("bid_count").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == 6000
    assert last.where("endtime != starttime + INTERVAL 10 SECONDS").isEmpty()
    want = read_market(spark, SF_DIR).bid.groupBy("bidder").count()
    assert rows(last.groupBy("bidder").agg(F.sum("n").alias("count"))) == rows(want)


def test_ranks_from_state(spark, places, tmp_path):
    changes = streamed(spark, places, tmp_path, "q19").select("auction", "bidder", "price", "rank_number")
    assert set(rows(QUERIES["q19"](spark, SF_DIR).select("auction", "bidder", "price", "rank_number"))) <= set(rows(changes))


@pytest.mark.parametrize("name", sorted(streams.MERGED))
def test_merged_tables_end_at_the_batch_result(spark, places, tmp_path, name):
    merged, last = streams.MERGED[name], []
    table = merged.table(str(tmp_path / "table"))
    changes = merged.changes(stream_market(spark, **places))
    start_merging(changes, table, merged.partial, str(tmp_path / "checkpoint"), lambda _, n: last.append(n)).awaitTermination()
    assert rows(merged.result(table.version(spark, last[-1]))) == rows(MARKET_QUERIES[name](read_market(spark, SF_DIR)))


def test_every_query_has_a_stream_form():
    batch_only = {"q103_20", "q104_20", "q7_two_seconds"}  # q103, q104 and q7 with other numbers
    assert set(MARKET_QUERIES) - batch_only - {"base"} <= {*streams.DIRECT, *streams.PER_BATCH, *streams.MERGED}


def test_a_run_is_written_again_seldom(spark, tmp_path):
    table = KeyedTable(str(tmp_path), ("k",), (F.sum("n").alias("n"),))
    for number in range(7):
        table.upsert(spark.createDataFrame([(number, 1), (0, 1)], "k long, n long"), number)
        want = {k: 1 for k in range(number + 1)} | {0: number + 2}
        assert {r["k"]: r["n"] for r in table.version(spark, number).collect()} == want
    assert [spark.read.parquet(f"{tmp_path}/run{n}").count() for n in range(1, 8)] == [1, 2, 2, 4, 2, 3, 2]


def test_old_runs_are_cleared(spark, tmp_path):
    """What is left makes the table, and lets the last batch run again."""
    table = KeyedTable(str(tmp_path), ("k",), (F.sum("n").alias("n"),))
    for number in range(11):
        one = spark.createDataFrame([(number, 1), (0, 1)], "k long, n long")
        for _ in range(2):
            table.upsert(one, number)
        table.clear(spark, number)
        assert {r["k"]: r["n"] for r in table.version(spark, number).collect()} == {k: 1 for k in range(number + 1)} | {0: number + 2}
    assert sorted(p.name for p in tmp_path.glob("run*")) == ["run10", "run11", "run8"]


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    table = KeyedTable(str(tmp_path), ("k",), (F.sum("n").alias("n"),))
    one = spark.createDataFrame([(1, 2)], "k long, n long")
    table.upsert(one, 0)
    table.upsert(one, 1)
    assert rows(table.upsert(one, 1)) == [("1", "4")]


def test_union_stream(spark, tmp_path):
    events = union_events(read_market(spark, SF_DIR))
    folder = str(tmp_path / "events")
    events.select("event_type", *[F.when(F.lit(True), F.col(c)).alias(c) for c in ("person", "auction", "bid")]).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSS").json(folder)
    market = stream_union(spark, Source("json", folder))
    start(market.bid.select("auction", "price"), str(tmp_path / "checkpoint"), kind="memory", name="union_bids").awaitTermination()
    assert spark.table("union_bids").count() == 6000


def test_partitioned_files_and_keyed_messages(spark, places, tmp_path):
    query, _ = streams.DIRECT["q10"]
    start_partitioned(query(stream_market(spark, **places)), str(tmp_path / "checkpoint"), str(tmp_path / "files")).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "files"))
    assert back.count() == 6000 and {"dt", "hm"} <= set(back.columns)
    message = upsert_messages(spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).first()
    assert (message["key"], message["value"]) == ('{"k":1}', '{"k":1,"v":"a"}')
