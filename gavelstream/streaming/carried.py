"""Results that follow event time, from tables that micro-batches carry along: no call of Python for a key or a row.

Each batch reads what the one before it left (carried/<number>), writes what
has become final (out/<number>) and what later batches still need. A batch that
runs again starts from the same table and writes its own parts anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.operators.joins import asof_join
from gavelstream.operators.windows import hottest_by_pane, pane_counts
from gavelstream.sources.auction_tables import Market
from gavelstream.streaming.sinks import remove


@dataclass(frozen=True)
class Carried:
    """Where the tables of each batch are."""

    folder: str

    def write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.folder}/{name}/{number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def before(self, like: DataFrame, name: str, number: int) -> DataFrame:
        """The table of the batch before this one, empty for the first; its columns are those of `like`."""
        return like.sparkSession.read.schema(like.schema).parquet(f"{self.folder}/{name}/{number - 1}") if number else like.limit(0)

    def clear(self, spark: SparkSession, names: tuple[str, ...], number: int) -> None:
        """Delete the tables from two batches before this one."""
        for name in names:
            if number > 1:
                remove(spark, f"{self.folder}/{name}/{number - 2}")

    def passed(self, batch: DataFrame, time: str, lateness: dict[str, int], number: int) -> tuple[int | None, int | None]:
        """What all sides (column _side) are past by their lateness (seconds), before this batch and with it, in microseconds; None as long as one has not come."""
        newest = batch.groupBy("_side").agg(F.max(F.unix_micros(time)).alias("newest"))
        past = self.before(newest, "newest", number)

        def least(table: DataFrame) -> int | None:
            found = {r["_side"]: r["newest"] - lateness[r["_side"]] * 1_000_000 for r in table.collect() if r["newest"] is not None}
            return min(found.values()) if len(found) == len(lateness) else None

        now = self.write(newest.unionByName(past).groupBy("_side").agg(F.max("newest").alias("newest")), "newest", number)
        return least(past) if number else None, least(now)

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out/*")


@dataclass(frozen=True)
class HottestWindows(Carried):
    """The keys with the most rows in each hopping window, in the batch that closes it.

    Spark's own state counts rows by pane and gives a pane when the watermark
    has passed it. A batch closes the windows that end with its newest pane at
    the latest; panes of open windows are carried along.
    """

    key: str
    slide_seconds: int
    slides: int

    def panes(self, rows: DataFrame, time: str) -> DataFrame:
        """The stream to take: key, pane, n."""
        return pane_counts(rows, [self.key], time, self.slide_seconds)

    def take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = self.write(batch, "new", number)
        newest = new.agg((F.unix_micros(F.max("pane")) + self.slide_seconds * 1_000_000).alias("until"))
        past = self.before(newest, "until", number)
        after = past.first()["until"] if number else None
        until = self.write(newest.unionByName(past).agg(F.max("until").alias("until")), "until", number).first()["until"]
        panes = self.before(batch, "carried", number).unionByName(new)
        if until is not None:
            self._emit(panes, after, F.timestamp_micros(F.lit(until)), number)
            panes = panes.where(F.col("pane") >= F.timestamp_micros(F.lit(until - self.slides * self.slide_seconds * 1_000_000)))
        self.write(panes, "carried", number)
        self.clear(spark, ("new", "until", "carried"), number)

    def _emit(self, panes: DataFrame, after: int | None, until: Column, number: int) -> None:
        start = None if after is None else F.timestamp_micros(F.lit(after))
        self.write(hottest_by_pane(panes, self.key, self.slide_seconds, self.slides, start, until), "out", number)

    def close(self, spark: SparkSession, last: int, until: Column) -> None:
        """After the stream's last batch: the windows that end until then (what the watermark has reached)."""
        after = spark.read.parquet(f"{self.folder}/until/{last}").first()["until"]
        self._emit(spark.read.parquet(f"{self.folder}/carried/{last}"), after, until, last + 1)


@dataclass(frozen=True)
class AsOfTable(Carried):
    """As operators.joins.asof_join for two streams: each left row once, with the payload of the last right row at or before it.

    A left row waits until both sides are past it by their lateness (seconds);
    rows later than that go. Right rows are carried until a later one of their
    key is past as well.
    """

    key: str
    time: str
    payload: tuple[str, ...]
    lateness: dict[str, int]

    def rows(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The stream to take: both sides' rows."""
        one = left.select(self.key, self.time, F.lit("left").alias("_side"), F.struct(*left.columns).alias("_left"))
        other = right.select(self.key, self.time, F.lit("right").alias("_side"), F.struct(*self.payload).alias("_right"))
        return one.unionByName(other, allowMissingColumns=True)

    def take(self, batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, F.unix_micros(self.time)
        before, now = self.passed(batch, self.time, self.lateness, number)
        both = (batch if before is None else batch.where(at > before)).unionByName(self.before(batch, "carried", number))
        ready = F.lit(False) if now is None else at <= now
        lefts, rights = both.where("_side = 'left'"), both.where("_side = 'right'").select(self.key, self.time, "_right.*")
        self.write(asof_join(lefts.where(ready).select("_left.*"), rights, [self.key], self.time, self.time, list(self.payload)), "out", number)
        last = both.where("_side = 'right'").where(ready).groupBy(self.key).agg(F.max(self.time).alias(self.time), F.max_by("_right", self.time).alias("_right"))
        last = last.withColumns({"_side": F.lit("right"), "_left": F.lit(None).cast(both.schema["_left"].dataType)})
        self.write(both.where(~ready).unionByName(last.select(both.columns)), "carried", number)
        self.clear(spark, ("newest", "carried"), number)


@dataclass(frozen=True)
class EndedAuctions(Carried):
    """What a query makes of auctions and their bids, for each auction in the batch in which both streams are past its end by their lateness (seconds).

    An auction waits for its end, a bid for both streams to be past it and,
    if its auction is there, for that to end. Rows later than the lateness go.
    Ids are keys: an auction that comes again after its end is another one.
    """

    query: Callable[[Market], DataFrame]
    lateness: dict[str, int]

    def rows(self, market: Market) -> DataFrame:
        """The stream to take: rows of both kinds."""
        kinds = {"auction": market.auction, "bid": market.bid}
        one, other = (t.select("date_time", F.lit(kind).alias("_side"), F.struct(*t.columns).alias(f"_{kind}")) for kind, t in kinds.items())
        return one.unionByName(other, allowMissingColumns=True)

    def take(self, batch: DataFrame, number: int) -> None:
        at = F.unix_micros("date_time")
        before, now = self.passed(batch, "date_time", self.lateness, number)
        fresh = batch if before is None else batch.where(at > before)
        known = {}
        for kind in ("auction", "bid"):
            rows = fresh.where(F.col("_side") == kind).select(f"_{kind}.*")
            known[kind] = rows.unionByName(self.before(rows, kind, number))
        over, passed = (F.lit(False), F.lit(False)) if now is None else (F.unix_micros("expires") <= now, at <= now)
        auctions, bids = known["auction"], known["bid"]
        self.write(self.query(Market(None, auctions.where(over), bids.where(passed))), "out", number)
        waiting = self.write(auctions.where(~over), "auction", number)
        earliest = waiting.agg(F.min(F.unix_micros("date_time"))).first()[0]
        if now is not None:  # of the bids passed few are later than the first opening that waits, and are looked at
            bids = bids.where(at > (now if earliest is None else min(now, earliest - 1)))
            mine = waiting.select(F.col("id").alias("auction"), F.lit(True).alias("_waits")).distinct()
            bids = bids.join(mine, "auction", "left").where(~passed | F.col("_waits")).select(bids.columns)
        self.write(bids, "bid", number)
        self.clear(batch.sparkSession, ("newest", "auction", "bid"), number)


def start_carrying(rows: DataFrame, table: HottestWindows | AsOfTable | EndedAuctions, checkpoint: str) -> int:
    """Take what there is, and end; the number of the last batch."""
    numbers = []

    def one(batch: DataFrame, number: int) -> None:
        table.take(batch, number)
        numbers.append(number)

    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return numbers[-1]
