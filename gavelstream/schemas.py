"""Fixed schemas of the auction streams and of the benchmark's reports. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _TEXT = T.LongType(), T.StringType()


def person(time: T.DataType = T.TimestampType()) -> T.StructType:
    return _struct(id=_LONG, name=_TEXT, emailAddress=_TEXT, creditCard=_TEXT, city=_TEXT, state=_TEXT, date_time=time, extra=_TEXT)


def auction(time: T.DataType = T.TimestampType()) -> T.StructType:
    return _struct(
        id=_LONG, itemName=_TEXT, description=_TEXT, initialBid=_LONG, reserve=_LONG, date_time=time, expires=time, seller=_LONG, category=_LONG, extra=_TEXT
    )


def bid(time: T.DataType = T.TimestampType()) -> T.StructType:
    return _struct(auction=_LONG, bidder=_LONG, price=_LONG, channel=_TEXT, url=_TEXT, date_time=time, extra=_TEXT)


#: Tags of the union stream.
PERSON, AUCTION, BID = 0, 1, 2


def union_event(time: T.DataType = T.TimestampType()) -> T.StructType:
    """One stream of all three kinds: a tag, and a struct of each kind of which one is set."""
    return _struct(event_type=T.IntegerType(), person=person(time), auction=auction(time), bid=bid(time))


SIDE_INPUT = _struct(key=_LONG, value=_TEXT)
RESULT_REPORT = _struct(report_time=_TEXT, case=_TEXT, platform=_TEXT, execution_time=T.DoubleType(), output_size=T.IntegerType(), error=_TEXT)
STATS_REPORT = _struct(raw=_TEXT, report_time=_TEXT)

#: Names that other producers give to columns, by entity.
OTHER_NAMES = {
    "auction": {"item_name": "itemName", "initial_bid": "initialBid", "dateTime": "date_time"},
    "person": {"email_address": "emailAddress", "credit_card": "creditCard", "dateTime": "date_time"},
    "bid": {"dateTime": "date_time"},
}
