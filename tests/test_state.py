"""Queries in state against their batch twins: with nulls, out of order, batch by batch, and what is left in state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelstream.operators.joins import asof_join
from gavelstream.plans import relational, stateless
from gavelstream.plans.catalogue import MARKET_QUERIES
from gavelstream.sources.auction_tables import Market, read_market
from gavelstream.sources.readers import Source
from gavelstream.streaming import queries as streams
from gavelstream.streaming.auctions import bidding_sessions
from gavelstream.streaming.lateness import Grace
from gavelstream.streaming.lookups import VersionedTable, joining
from gavelstream.streaming.market import stream_market, with_instants, write_market
from gavelstream.streaming.sinks import TopTable, start, start_merging
from gavelstream.streaming.state import asof_join_stream

SF_DIR = "/root/testdata/sf0.001"
#: After everything else, so that the watermark passes all of it.
FAR = "TIMESTAMP_NTZ'2030-01-01 00:00:00'"


def with_nulls(market):
    """Every fifth name, bidder and price is null; so are bids' channels and auctions' sellers here and there."""
    fifth = lambda key, column, rest: F.when(F.col(key) % 5 == rest, F.lit(None)).otherwise(F.col(column))
    auction = market.auction.withColumns({"itemName": fifth("id", "itemName", 1), "extra": fifth("id", "extra", 2)})
    bid = market.bid.withColumns({"bidder": fifth("bidder", "bidder", 3), "price": F.when(F.col("price") % 7 == 1, F.lit(None)).otherwise(F.col("price")), "extra": fifth("auction", "extra", 4)})
    # bids of auctions that nobody opened
    strays = bid.where("auction % 50 = 7").withColumn("auction", F.col("auction") + 1_000_000)
    return Market(market.person, auction, bid.unionByName(strays))


def closed(market):
    """With a last auction and bid, long after all others."""
    auction, bid = (table.limit(1).withColumn("date_time", F.expr(FAR)) for table in (market.auction, market.bid))
    auction = auction.withColumns({"expires": F.expr(FAR), "id": F.lit(-1).cast("long")})
    bid = bid.withColumns({"auction": F.lit(-2).cast("long")})
    return Market(market.person, market.auction.unionByName(auction), market.bid.unionByName(bid))


@pytest.fixture(scope="module")
def market(spark):
    return with_nulls(read_market(spark, SF_DIR))


@pytest.fixture(scope="module")
def places(spark, market, tmp_path_factory):
    return write_market(closed(market), str(tmp_path_factory.mktemp("market")), files=3)


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(columns).collect())


def left_in_state(spark, checkpoint, *names):
    return {n: spark.read.format("statestore").option("stateVarName", n).load(str(checkpoint)).count() for n in names}


@pytest.mark.parametrize("name,state", [("q9", ("auction", "early", "best")), ("q9_session", ("auction", "early", "waiting", "session"))])
def test_ended_auctions_are_emitted_once_and_leave_the_state(spark, market, places, tmp_path, name, state):
    query, mode = streams.DIRECT[name]
    start(query(stream_market(spark, **places)), str(tmp_path / "c"), mode, "memory", name=f"state_{name}").awaitTermination()
    assert rows(spark.table(f"state_{name}")) == rows(MARKET_QUERIES[name](market))
    left = left_in_state(spark, tmp_path / "c", *state)
    # the last auction and bid alone may still be waiting
    assert left.pop("auction") <= 1 and left.pop("early") <= 1 and set(left.values()) == {0}


def _auction(number, opens, ends):
    t = dt.datetime(2024, 1, 1)
    return (number, f"item {number}", "d", 1, 1, t + dt.timedelta(seconds=opens), t + dt.timedelta(seconds=ends), 9, 10, "x")


def _bid(auction, bidder, price, at):
    return (auction, bidder, price, "c", "u", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), "x")


def _streamed(spark, tmp_path, batches):
    """Streams of one file for each batch of (auctions, bids)."""
    market = read_market(spark, SF_DIR)
    schemas = {"auction": with_instants(market.auction).schema, "bid": with_instants(market.bid).schema}
    for number, (auctions, bids) in enumerate(batches):
        for kind, part in (("auction", auctions), ("bid", bids)):
            spark.createDataFrame(part, schemas[kind]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{kind}-{number}"))
    spark.createDataFrame([], with_instants(market.person).schema).write.parquet(str(tmp_path / "person"))
    kinds = {k: Source("parquet", str(tmp_path / (k if k == "person" else f"{k}-*")), {"maxFilesPerTrigger": "1"}) for k in ("person", "auction", "bid")}
    whole = Market(market.person, *[spark.read.parquet(*[str(tmp_path / f"{k}-{n}") for n in range(len(batches))]) for k in ("auction", "bid")])
    return stream_market(spark, **kinds), whole


END = 10**7
BATCHES = [
    ([_auction(1, 0, 20_000), _auction(3, 0, 150)], [_bid(1, 5, 100, 20_000), _bid(1, 4, 70, 10), _bid(2, 1, 5, 100), _bid(1, 6, 30, 5), _bid(3, 9, 5, 150), _bid(3, 7, 5, 20)]),
    ([_auction(2, 50, 200)], [_bid(1, 7, 90, 7300), _bid(2, 8, 7, 200), _bid(2, 3, 60, 201), _bid(1, 1, 60, 7000), _bid(3, 6, 5, 20), _bid(3, 8, None, 30)]),
    ([_auction(-1, END, END)], [_bid(-2, 1, 1, END)]),
]


def test_winning_bid_at_the_very_end_and_before_its_auction(spark, tmp_path):
    """A bid at exactly `expires` counts, one later does not; of equal prices the earliest, then the smaller bidder's, wins; bids come before auctions."""
    stream, _ = _streamed(spark, tmp_path, BATCHES)
    start(streams.DIRECT["q9"][0](stream), str(tmp_path / "c"), "append", "memory", name="winning_edges").awaitTermination()
    # bids later than two hours after the opening are none, as in every stream here
    assert sorted((r["id"], r["bidder"], r["price"]) for r in spark.table("winning_edges").collect()) == [(1, 4, 70), (2, 8, 7), (3, 6, 5)]
    assert left_in_state(spark, tmp_path / "c", "best") == {"best": 0}


def test_sessions_time_out_before_the_auction_ends(spark, tmp_path):
    longest = 1000
    stream, whole = _streamed(spark, tmp_path, BATCHES)
    start(bidding_sessions(stream, longest), str(tmp_path / "c"), "append", "memory", name="session_edges").awaitTermination()
    within = whole.bid.join(whole.auction.select(F.col("id").alias("auction"), F.col("date_time").alias("o")), "auction").where("date_time <= o + INTERVAL 2 HOURS").drop("o")
    want = relational.q9_session(Market(whole.person, whole.auction, within), longest)
    assert rows(spark.table("session_edges")) == rows(want) and want.count() == 4


@pytest.mark.parametrize("name", ["q4", "q15", "q16", "q101", "q102", "q103", "q104", "q105"])
def test_merged_changes_end_at_the_batch_result_with_nulls(spark, market, places, tmp_path, name):
    merged, last = streams.MERGED[name], []
    table = merged.table(str(tmp_path / "table"))
    start_merging(merged.changes(stream_market(spark, **places)), table, merged.partial, str(tmp_path / "c"), lambda _, n: last.append(n)).awaitTermination()
    assert rows(merged.result(table.version(spark, last[-1]))) == rows(MARKET_QUERIES[name](closed(market)))


def test_seen_ids_leave_the_state_with_their_day(spark, market, places, tmp_path):
    merged = streams.MERGED["q15"]
    start_merging(merged.changes(stream_market(spark, **places)), merged.table(str(tmp_path / "t")), merged.partial, str(tmp_path / "c")).awaitTermination()
    assert left_in_state(spark, tmp_path / "c", "seen")["seen"] <= 2  # of the last bid's own day


def test_change_log_of_averages(spark, places, tmp_path):
    """After each micro-batch the log's last rows are the batch result over what has come."""
    merged, folder, after = streams.MERGED["q4"], str(tmp_path / "table"), {}
    table = merged.table(folder)
    log = streams.change_log(merged, folder)

    def then(now, number):
        log(now, number)
        after[number] = {r["category"]: r["avg_price"] for r in merged.result(now).collect()}

    start_merging(merged.changes(stream_market(spark, **places)), table, merged.partial, str(tmp_path / "c"), then).awaitTermination()
    known = {}
    for number in sorted(after):
        known |= {r["category"]: r["avg_price"] for r in spark.read.parquet(f"{folder}/log/{number}").collect()}
        assert known == after[number]
    assert len(after) > 2 and len(set(map(str, after.values()))) > 2


def test_windows_from_panes(spark, market, places, tmp_path):
    """One row of state for a key and pane; each window once, when it closes."""
    counts, finish = streams.PER_BATCH["q5_many_windows"]
    found = []
    stream = counts(stream_market(spark, **places))
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: found.extend(rows(finish(batch)))).start().awaitTermination()
    assert sorted(found) == rows(MARKET_QUERIES["q5_many_windows"](market))
    assert left_in_state(spark, tmp_path / "c", "panes", "next") == {"panes": 1, "next": 1}


def test_asof_join_of_streams(spark, tmp_path):
    """Equal to the batch join; right rows behind the watermark go but for the last."""
    second = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    lefts = [[(k % 3, second(7 * k), k) for k in range(part, 60, 2)] for part in (0, 1)] + [[(0, second(10**6), -1)]]
    rights = [[(k % 4, second(5 * k), f"r{k}") for k in range(10, 50)], [(2, second(1), None)], [(0, second(10**6), "end")]]
    sides = {"left": (lefts, "key long, at timestamp, n long"), "right": (rights, "key long, at timestamp, value string")}
    tables, flows = {}, {}
    for side, (parts, schema) in sides.items():
        for number, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{side}-{number}"))
        tables[side] = spark.read.parquet(*[str(tmp_path / f"{side}-{n}") for n in range(3)])
        flows[side] = spark.readStream.schema(tables[side].schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / f"{side}-*")).withWatermark("at", "10 minutes")
    joined = asof_join_stream(flows["left"], flows["right"], "key", "at", ["value"])
    start(joined, str(tmp_path / "c"), "append", "memory", name="asof_streamed").awaitTermination()
    want = asof_join(tables["left"], tables["right"], ["key"], "at", "at", ["value"]).where("n >= 0")
    assert rows(spark.table("asof_streamed")) == rows(want) and want.count() > 30
    left = left_in_state(spark, tmp_path / "c", "lefts", "rights")
    assert left["lefts"] <= 1 and left["rights"] <= 5


def test_a_top_table_keeps_the_first_rows(spark, tmp_path):
    table = TopTable(str(tmp_path), ("k",), (F.max("n").alias("n"),), (F.desc("n"), F.asc("k")), 3)
    counts = {}
    for number, batch in enumerate([{1: 5, 2: 1, 3: 1, 4: 1}, {5: 2}, {}, {4: 9, 2: 2}, {3: 2, 1: 6}]):
        counts |= batch
        for _ in range(2):  # a batch that runs again changes nothing
            found = table.upsert(spark.createDataFrame(list(batch.items()), "k long, n long"), number)
        assert sorted((-r["n"], r["k"]) for r in found.collect()) == sorted((-n, k) for k, n in counts.items())[:3]


def test_lookups_see_the_table_of_their_batch(spark, market, tmp_path):
    """A change between two batches is seen by the second only; a batch that runs again sees its own version."""
    side, found, failing = VersionedTable(str(tmp_path / "side")), {}, [True]
    keyed = lambda value: spark.range(10_000).select(F.col("id").alias("key"), F.lit(value).alias("value"))
    bids = with_instants(market.bid).where("auction < 900")
    for part in (0, 1):
        bids.where(f"auction % 2 = {part}").coalesce(1).write.parquet(str(tmp_path / f"bids-{part}"))
    stream = spark.readStream.schema(bids.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "bids-*"))

    def then(joined, number):
        values = {r["value"] for r in joined.select("value").distinct().collect()}
        if number == 1 and failing[0]:
            failing[0] = False
            raise RuntimeError("lost")
        found[number] = values
        if number == 0:
            side.publish(keyed("new"))

    assert side.newest(spark) is None and side.publish(keyed("old")) == 1
    join = lambda batch, table: stateless.q13(Market(None, None, batch), table)
    run = lambda: joining(stream, side, join, str(tmp_path / "ledger"), then).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination()
    side.publish(keyed("newer"))
    run().awaitTermination()
    assert found == {0: {"old"}, 1: {"new"}}


def test_grace_apart_from_the_watermark(spark, tmp_path):
    """Rows in time, within and beyond the grace; the join has the first two, the side output the third."""
    auctions = [_auction(k, 0, 500) for k in range(1, 6)]
    bids = [[_bid(1, 1, 10, 100), _bid(2, 1, 10, 400)], [_bid(1, 2, 30, 397), _bid(3, 1, 7, 391), _bid(4, 1, 9, 387), _bid(5, 1, 1, 300)], [_bid(5, 2, 2, 410), _bid(1, 3, 99, 50)]]
    market = read_market(spark, SF_DIR)
    schema = with_instants(market.bid).schema
    for number, part in enumerate(bids):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"bid-{number}"))
    grace = Grace(str(tmp_path / "grace"), "date_time", lateness_seconds=4, grace_seconds=10)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "bid-*"))
    grace.dealing(stream).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    grace.dealing(stream).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()  # all batches once more
    assert {r["lateness"]: r["n"] for r in grace.counts(spark, schema).collect()} == {"on time": 4, "in grace": 2, "beyond": 2}
    assert sorted((r["auction"], r["price"]) for r in grace.beyond(spark, schema).collect()) == [(1, 99), (5, 1)]

    opened = spark.createDataFrame(auctions, with_instants(market.auction).schema)
    opened.coalesce(1).write.parquet(str(tmp_path / "auction"))
    flow = spark.readStream.schema(opened.schema).parquet(str(tmp_path / "auction")).withWatermark("date_time", "14 seconds")
    joined = streams.valid_bid_stream(Market(None, flow, grace.taken(spark, schema))).select("id", "price")
    start(joined, str(tmp_path / "c3"), kind="memory", name="grace_joined").awaitTermination()
    assert sorted(map(tuple, spark.table("grace_joined").collect())) == [(1, 10), (1, 30), (2, 10), (3, 7), (4, 9), (5, 2)]
