"""Operators with state of their own."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelstream.shipping import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, which the processors here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class TopRows(StatefulProcessor):
    """Keeps the n first rows of each key by an order, and emits a key's rows with their rank when they change."""

    def __init__(self, columns: list[str], schema: T.StructType, order: list[str], ascending: list[bool], n: int):
        self._columns, self._schema, self._order, self._ascending, self._n = columns, schema, order, ascending, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getListState("kept", self._schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self._kept.get()] if self._kept.exists() else []
        best = before + [tuple(r) for part in rows for r in part[self._columns].itertuples(index=False)]
        for name, ascending in reversed(list(zip(self._order, self._ascending))):  # stable sorts, the last column first
            best.sort(key=itemgetter(self._columns.index(name)), reverse=not ascending)
        best = best[: self._n]
        if best != before:
            self._kept.put(best)
            yield pd.DataFrame(best, columns=self._columns).assign(rank_number=range(1, len(best) + 1))

    def close(self) -> None:
        pass


def top_rows_stream(rows: DataFrame, key: str, order: list[str], ascending: list[bool], n: int, mode: str) -> DataFrame:
    """A change log of each key's first n rows; a later row for a key and rank replaces the one before.

    The state holds n rows for each key.
    """
    ship_package(rows.sparkSession)
    columns, schema = rows.columns, rows.schema
    out = T.StructType([*schema.fields, T.StructField("rank_number", T.LongType())])
    processor = TopRows(columns, schema, order, ascending, n)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode=mode, timeMode="None")


class NewIds(StatefulProcessor):
    """Emits, for each key and batch, how many rows came and how many ids are new, for each of some flags.

    The state maps each id to the flags under which it has been seen, and goes
    when the watermark has reached the end of the key's time.
    """

    def __init__(self, out: T.StructType, n_keys: int, flags: list[str]):
        self._row, self._n_keys, self._flags = Row(*out.fieldNames()), n_keys, flags

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getMapState("seen", "id long", "flags int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts, masks, latest, end = Counter(), {}, None, None
        for row in rows:
            mask = row["flags"]
            counts[mask] += 1
            latest, end = max(latest or row["at"], row["at"]), row["end"]
            if row["id"] is not None:
                masks[row["id"]] = masks.get(row["id"], 0) | mask
        new = Counter()
        for number, mask in masks.items():
            known = self._seen.getValue((number,))
            before = known[0] if known else 0
            if mask & ~before:
                self._seen.updateValue((number,), (before | mask,))
                new[mask & ~before] += 1
        self._handle.registerTimer(end // 1000)
        totals = [sum(n for mask, n in found.items() if mask >> bit & 1) for found in (counts, new) for bit in range(len(self._flags))]
        yield self._row(*key[: self._n_keys], key[self._n_keys], latest, *totals)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def distinct_changes(rows: DataFrame, time: str, keys: dict[str, Column], ids: dict[str, str], flags: dict[str, Column], parts: int = 64) -> DataFrame:
    """keys, kind, latest, n_<flag>, new_<flag>: by kind of id, what each micro-batch adds to counts and distinct counts of a day.

    A key's ids lie in `parts` groups by their hash, so that a day is no one
    task's. Null ids are rows, but no ids. `latest` is the batch's last time.
    """
    ship_package(rows.sparkSession)
    mask = sum((F.when(c, 2**bit).otherwise(0) for bit, c in enumerate(flags.values())), F.lit(0))
    one = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id")) for kind, c in ids.items()])).alias("one")
    end = F.unix_micros(F.date_trunc("day", time) + F.expr("INTERVAL 1 DAY"))
    small = rows.select(time, *[c.alias(k) for k, c in keys.items()], mask.alias("flags"), F.unix_micros(time).alias("at"), end.alias("end"), one).select("*", "one.*").drop("one")
    dealt = small.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    names = [f"{n}_{f}" for n in ("n", "new") for f in flags]
    out = T.StructType([*[dealt.schema[k] for k in keys], T.StructField("kind", T.StringType()), T.StructField("latest", T.LongType()), *[T.StructField(n, T.LongType()) for n in names]])
    found = dealt.groupBy(*keys, "kind", "part").transformWithState(statefulProcessor=NewIds(out, len(keys), list(flags)), outputStructType=out, outputMode="append", timeMode="EventTime")
    return found.withColumn("latest", F.timestamp_micros("latest"))


class PaneWindows(StatefulProcessor):
    """Counts a key's rows per pane, and emits each hopping window's sum once the watermark has reached its end.

    A row adds to one pane. Sums slide: a window's is the one's before, with
    the pane that enters and without the one that leaves. Panes go when their
    last window has been emitted.
    """

    def __init__(self, out: T.StructType, slide: int, slides: int):
        self._row, self._slide, self._size = Row(*out.fieldNames()), slide, slide * slides

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._panes = handle.getMapState("panes", "pane long", "n long")
        self._next = handle.getValueState("next", "end long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counts = Counter(row["at"] // self._slide * self._slide for row in rows)
        for pane, n in counts.items():
            known = self._panes.getValue((pane,))
            self._panes.updateValue((pane,), (n + (known[0] if known else 0),))
        held = self._next.get()
        self._await(min([min(counts) + self._slide, *([held[0]] if held else [])]))
        return iter(())

    def _await(self, end: int) -> None:
        self._next.update((end,))
        self._handle.registerTimer(-(-end // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._next.get(), timerValues.getCurrentWatermarkInMs() * 1000
        if not held or held[0] > now:
            return
        panes = {p[0]: n[0] for p, n in self._panes.iterator()}
        end = held[0]
        total = sum(n for p, n in panes.items() if end - self._size <= p < end)
        while panes and end <= now:
            if total:
                yield self._row(*key, end - self._size, end, total)
            leaving = end - self._size
            total -= panes.get(leaving, 0)
            if leaving in panes:
                del panes[leaving]
                self._panes.removeKey((leaving,))
            if not total and panes:  # on to the next pane that has rows
                end = max(end, min(panes))
            total += panes.get(end, 0)
            end += self._slide
        if panes:
            self._await(end)
        else:
            self._next.clear()

    def close(self) -> None:
        pass


def pane_window_counts(rows: DataFrame, key: str, time: str, slide_seconds: int, slides: int) -> DataFrame:
    """key, starttime, endtime, num: rows in each hopping window, once the watermark has reached its end.

    All keys' counts of a window come in one micro-batch.
    """
    ship_package(rows.sparkSession)
    out = T.StructType([rows.schema[key], *[T.StructField(n, T.LongType()) for n in ("starttime", "endtime", "num")]])
    processor = PaneWindows(out, slide_seconds * 1_000_000, slides)
    placed = rows.select(key, time, F.unix_micros(time).alias("at"))
    found = placed.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("starttime", "endtime")})


class AsOf(StatefulProcessor):
    """Joins left rows to the last right row of their key at or before their time.

    Right rows lie in order of time. A left row waits until the watermark has
    reached it; then no earlier right row can come, and a binary search finds
    its match. Right rows go once a later one is behind the watermark as well.
    """

    def __init__(self, left: T.StructType, right: T.StructType, out: T.StructType):
        self._left_schema, self._right_schema, self._row = left, right, Row(*out.fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        at = T.StructField("_at", T.LongType())
        self._lefts = handle.getListState("lefts", T.StructType([at, *self._left_schema.fields]))
        self._rights = handle.getListState("rights", T.StructType([at, *self._right_schema.fields]))

    @staticmethod
    def _all(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lefts, rights = [], []
        for row in rows:
            if row["_left"] is not None:
                lefts.append((row["_at"], *row["_left"].values()))
            else:
                rights.append((row["_at"], *row["_right"].values()))
        if lefts:
            self._lefts.appendList(lefts)
        if rights:
            self._rights.put(sorted(self._all(self._rights) + rights, key=itemgetter(0)))
        # the first left row asks for the next look; without any, right rows ask for one to go
        self._await(min(r[0] for r in lefts) if lefts else max(r[0] for r in rights))
        return iter(())

    def _await(self, at: int) -> None:
        self._handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        lefts, rights = self._all(self._lefts), self._all(self._rights)
        times = [r[0] for r in rights]
        for left in lefts:
            if left[0] <= now:
                place = bisect_right(times, left[0])
                if place:
                    yield self._row(*left[1:], *rights[place - 1][1:])
        later = [x for x in lefts if x[0] > now]
        self._lefts.clear()
        if later:
            self._lefts.appendList(later)
            self._await(min(x[0] for x in later))
        kept = rights[max(0, bisect_right(times, now) - 1) :]
        if len(kept) < len(rights):
            self._rights.put(kept)

    def close(self) -> None:
        pass


def asof_join_stream(left: DataFrame, right: DataFrame, key: str, time: str, payload: list[str]) -> DataFrame:
    """As operators.joins.asof_join for two streams with watermarks on `time`: each left row once, with right's payload.

    Left rows without a match go. Of right rows of one time the last to come counts.
    """
    ship_package(left.sparkSession)
    at = F.unix_micros(time).alias("_at")
    # times are microseconds while Python has them, so that no time zone touches them
    instants = [f.name for side, names in ((left, left.columns), (right, payload)) for f in side.select(*names).schema if f.dataType == T.TimestampType()]

    def packed(names: list[str]) -> Column:
        return F.struct(*[F.unix_micros(c).alias(c) if c in instants else F.col(c) for c in names])

    with_left = left.select(key, time, at, packed(left.columns).alias("_left"))
    with_right = right.select(key, time, at, packed(payload).alias("_right"))
    left_schema, right_schema = with_left.schema["_left"].dataType, with_right.schema["_right"].dataType
    both = with_left.unionByName(with_right, allowMissingColumns=True)
    out = T.StructType([*left_schema.fields, *right_schema.fields])
    found = both.groupBy(key).transformWithState(statefulProcessor=AsOf(left_schema, right_schema, out), outputStructType=out, outputMode="append", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in instants}) if instants else found
