"""Auctions that a stream hands on with their bids when they have ended."""

import datetime as dt

import pytest
from test_state import _auction, _bid, _streamed, closed, rows, with_nulls

from gavelstream.plans.catalogue import MARKET_QUERIES, QUERIES
from gavelstream.sources.auction_tables import Market, read_market
from gavelstream.streaming import replay
from gavelstream.streaming.carried import EndedAuctions, start_carrying
from gavelstream.streaming.market import stream_market, write_market

SF_DIR = "/root/testdata/sf0.001"
LATE = 10**7


def ended(spark, stream, tmp_path, name):
    each, result = replay.ENDED[name]
    table = EndedAuctions(str(tmp_path / "ended"), each, {"auction": 4, "bid": 4})
    last = start_carrying(table.rows(stream), table, str(tmp_path / "c"))
    return result(table.result(spark)), {kind: spark.read.parquet(f"{table.folder}/{kind}/{last}") for kind in ("auction", "bid")}


@pytest.mark.parametrize("name", sorted(replay.ENDED))
def test_equals_batch_with_nulls_and_carries_what_is_open(spark, tmp_path, name):
    nulls = with_nulls(read_market(spark, SF_DIR))
    places = write_market(closed(nulls), str(tmp_path / "market"), files=3, names=("auction", "bid"))
    found, left = ended(spark, stream_market(spark, **places), tmp_path, name)
    assert rows(found) == rows(MARKET_QUERIES[name](nulls))
    assert left["auction"].count() <= 1 and left["bid"].count() <= 1


@pytest.mark.parametrize("name", sorted(replay.ENDED))
def test_long_auctions_and_bids_before_them(spark, tmp_path, name):
    """An auction of six hours, bids that come before their auction and bids of auctions that never come; the joined forms lose bids after two hours."""
    batches = [
        ([_auction(1, 0, 6 * 3600)], [_bid(1, 5, 100, 10), _bid(2, 1, 5, 100), _bid(9, 1, 5, 20)]),
        ([_auction(2, 50, 200)], [_bid(1, 7, 900, 3 * 3600), _bid(2, 8, 7, 200), _bid(2, 3, 60, 201)]),
        ([_auction(3, 4 * 3600, 5 * 3600)], [_bid(1, 9, 800, 6 * 3600), _bid(3, 9, None, 4 * 3600 + 1)]),
        ([_auction(-1, LATE, LATE)], [_bid(-2, 1, 1, LATE)]),
    ]
    stream, whole = _streamed(spark, tmp_path, batches)
    found, left = ended(spark, stream, tmp_path, name)
    assert rows(found) == rows(MARKET_QUERIES[name](whole))
    assert [r["id"] for r in left["auction"].collect()] == [-1] and [r["auction"] for r in left["bid"].collect()] == [-2]


def test_the_last_row_is_behind_tables_of_many_years(spark):
    market = read_market(spark, SF_DIR)
    late = market.auction.selectExpr("max(date_time) + INTERVAL '100' YEAR AS t").first()["t"]
    last = replay.ended(Market(market.person, market.auction, market.bid)).auction.where("id = -1").first()["date_time"]
    assert late > dt.datetime(2100, 1, 1) and last > late


@pytest.mark.parametrize("name", sorted(replay.ENDED))
def test_registered_query_keeps_no_join_in_state(spark, name, monkeypatch):
    taken = []
    monkeypatch.setattr(replay, "start_carrying", lambda stream, *rest: taken.append(stream._jdf.queryExecution().logical().toString()) or start_carrying(stream, *rest))
    assert rows(QUERIES[f"stream_{name}"](spark, SF_DIR)) == rows(QUERIES[name](spark, SF_DIR))
    assert len(taken) == 1 and "Join" not in taken[0]
