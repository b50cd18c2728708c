"""A deterministic generator of persons, auctions and bids, as tables or as a paced stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.sources.auction_tables import Market

#: Of fifty events, the first is a person, three are auctions, the rest bids.
BLOCK, PERSONS, AUCTIONS = 50, 1, 3
#: Milliseconds between events.
STEP_MS = 10


def _draw(n: int, *salt: str) -> Column:
    """A number from 0 to n - 1 that follows from the event's number."""
    return F.pmod(F.xxhash64("n", *[F.lit(s) for s in salt]), F.lit(n))


def _time(offset_ms: Column | int = 0) -> Column:
    return F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(secs=((F.col("n") * STEP_MS + offset_ms) / 1000).cast("decimal(18,6)"))


def split_events(numbers: DataFrame) -> Market:
    """The three tables of events numbered n, each a function of its number."""
    block, place = F.floor(F.col("n") / BLOCK).cast("long"), F.col("n") % BLOCK
    persons = numbers.where(place < PERSONS)
    auctions = numbers.where((place >= PERSONS) & (place < PERSONS + AUCTIONS))
    bids = numbers.where(place >= PERSONS + AUCTIONS)
    last_auction = block * AUCTIONS + AUCTIONS - 1
    states = F.array(*[F.lit(s) for s in ("or", "wy", "ca", "id", "az")])
    channels = F.array(*[F.lit(c) for c in ("Apple", "Google", "Facebook", "Baidu")])
    odd = F.concat(F.lit("channel-"), _draw(10_000, "channel").cast("string"))
    url = F.concat(F.lit("https://www.example.com/d"), _draw(7, "u").cast("string"), F.lit("/e"), _draw(5, "v").cast("string"), F.lit("/f/item.htm?query=1"))
    person = persons.select(
        block.alias("id"),
        F.concat(F.lit("person "), block.cast("string")).alias("name"),
        F.concat(F.lit("p"), block.cast("string"), F.lit("@example.com")).alias("emailAddress"),
        F.lpad(block.cast("string"), 16, "0").alias("creditCard"),
        F.concat(F.lit("city_"), _draw(100, "city").cast("string")).alias("city"),
        F.element_at(states, (_draw(5, "state") + 1).cast("int")).alias("state"),
        _time().alias("date_time"),
        F.lit("").alias("extra"),
    )
    auction = auctions.select(
        (block * AUCTIONS + place - PERSONS).alias("id"),
        F.concat(F.lit("item_"), _draw(997, "item").cast("string")).alias("itemName"),
        F.lit("description").alias("description"),
        (_draw(100, "initial") + 1).alias("initialBid"),
        _draw(1000, "reserve").alias("reserve"),
        _time().alias("date_time"),
        _time(2000 + _draw(7000, "open")).alias("expires"),
        F.greatest(block - _draw(100, "seller"), F.lit(0)).alias("seller"),
        (10 + _draw(5, "category")).alias("category"),
        F.lit("").alias("extra"),
    )
    bid = bids.select(
        F.greatest(last_auction - _draw(100, "auction"), F.lit(0)).alias("auction"),
        F.greatest(block - _draw(100, "bidder"), F.lit(0)).alias("bidder"),
        F.floor(F.pow(F.lit(10.0), 2 + _draw(6000, "price") / 1000)).cast("long").alias("price"),
        F.when(_draw(2, "kind") == 0, F.element_at(channels, (_draw(4, "big") + 1).cast("int"))).otherwise(odd).alias("channel"),
        F.when(_draw(10, "id") < 9, F.concat(url, F.lit("&channel_id="), _draw(10_000, "channel").cast("string"))).otherwise(url).alias("url"),
        _time().alias("date_time"),
        F.lit("ccc").alias("extra"),
    )
    return Market(person, auction, bid)


def generate(spark: SparkSession, events: int, generators: int = 3) -> Market:
    """So many events, in a partition per generator."""
    return split_events(spark.range(0, events, 1, generators).toDF("n"))


def paced(spark: SparkSession, events: int, events_per_second: int, generators: int = 3) -> DataFrame:
    """Numbers n as a stream for split_events, a second's worth in each micro-batch; a trigger of one second keeps the pace."""
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", events_per_second).option("numPartitions", generators).load()
    return rows.select(F.col("value").alias("n")).where(F.col("n") < events)
