"""Time windows: tumbling, hopping (also from panes), sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumble(time: str, size: str) -> Column:
    return F.window(time, size)


def hop(time: str, size: str, slide: str) -> Column:
    """Windows of a size, one per slide; a row falls in size / slide of them."""
    return F.window(time, size, slide)


def _seconds(n: Column | int) -> Column:
    return F.make_dt_interval(secs=n if isinstance(n, Column) else F.lit(n))


def pane_counts(df: DataFrame, keys: list[str], time: str, slide_seconds: int) -> DataFrame:
    """keys, pane, n: rows per slide, by where it begins."""
    return df.groupBy(*keys, F.window(time, f"{slide_seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("pane"), "n")


def _held_counts(panes: DataFrame, keys: list[str], slide_seconds: int, slides: int, name: str) -> DataFrame:
    """keys, start, until, count: the count of every window that begins from start on and before until."""
    enters = F.struct((F.col("pane") - _seconds(slide_seconds * (slides - 1))).alias("start"), F.col("n").alias("change"))
    leaves = F.struct((F.col("pane") + _seconds(slide_seconds)).alias("start"), (-F.col("n")).alias("change"))
    changes = panes.select(*keys, F.explode(F.array(enters, leaves)).alias("c")).select(*keys, "c.*")
    order = Window.partitionBy(*keys).orderBy("start")
    # rows of one start share their sum, and the last of them alone lasts
    held = changes.select(*keys, "start", F.sum("change").over(order).alias(name), F.lead("start").over(order).alias("until"))
    return held.where((F.col(name) > 0) & (F.col("until") > F.col("start")))


def hop_counts_by_pane(df: DataFrame, keys: list[str], time: str, slide_seconds: int, slides: int, name: str = "num") -> DataFrame:
    """keys, starttime, endtime, count for hopping windows of `slides` slides each.

    Rows are counted per slide (pane) first, with partial sums before the
    shuffle, so that a hot key's rows stay where they are; the few counts are
    dealt out by key. A pane adds to the window that it enters and takes away
    where it leaves, and a running sum over these changes holds until the next:
    windows come from as many numbers as there are changes, not panes times
    slides.
    """
    held = _held_counts(pane_counts(df, keys, time, slide_seconds), keys, slide_seconds, slides, name)
    lasting = F.timestamp_diff("SECOND", F.col("start"), F.col("until")) / slide_seconds
    windows = held.select(*keys, "start", name, F.explode(F.sequence(F.lit(0), lasting.cast("int") - 1)).alias("k"))
    placed = windows.withColumn("starttime", F.col("start") + _seconds(F.col("k") * slide_seconds))
    return placed.select(*keys, "starttime", (F.col("starttime") + _seconds(slide_seconds * slides)).alias("endtime"), name)


def hottest_by_pane(panes: DataFrame, key: str, slide_seconds: int, slides: int, after: Column | None = None, until: Column | None = None) -> DataFrame:
    """key, num, starttime, endtime: the keys with the most rows in each hopping window, all of equal ones; of windows that end later than `after`, and not later than `until`.

    A key's windows are not listed. Of counts that hold for the same stretch of
    windows only the greatest can be any window's greatest, and of these few
    stretches each window takes its own, within the stretch of `slides` windows
    that it lies in; their keys come back by a join.
    """
    held = _held_counts(panes, [key], slide_seconds, slides, "num")
    epoch = F.timestamp_seconds(F.lit(0)) if held.schema["start"].dataType == T.TimestampType() else F.lit("1970-01-01").cast("timestamp_ntz")

    def place(time: Column) -> Column:
        return (F.timestamp_diff("SECOND", epoch, time) / slide_seconds).cast("long")

    first, past = place(F.col("start")), place(F.col("until"))
    if after is not None:
        first = F.greatest(first, place(after) - (slides - 1))
    if until is not None:
        past = F.least(past, place(until) - (slides - 1))
    held = held.select(key, "num", first.alias("first"), past.alias("past")).where("first < past")
    most = held.groupBy("first", "past").agg(F.max("num").alias("num"))
    pieces = most.withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / slides), F.floor((F.col("past") - 1) / slides))))
    grouped = pieces.groupBy("piece").agg(F.collect_list(F.struct("first", "past", "num")).alias("all"))
    begins = F.col("piece") * slides

    def held_at(x: Column, at: Column) -> Column:
        return (x["first"] <= at) & (at < x["past"])

    tops = F.transform(F.sequence(begins, begins + (slides - 1)), lambda at: F.struct(at.alias("at"), F.array_max(F.transform(F.filter("all", lambda x: held_at(x, at)), lambda x: x["num"])).alias("num")))
    windows = grouped.select("all", F.explode(tops).alias("top")).where("top.num IS NOT NULL")
    chosen = windows.select("top.at", F.explode(F.filter("all", lambda x: held_at(x, F.col("top.at")) & (x["num"] == F.col("top.num")))).alias("x")).select("at", "x.*")
    found = held.join(chosen, ["first", "past", "num"]).withColumn("starttime", epoch + _seconds(F.col("at") * slide_seconds))
    return found.select(key, "num", "starttime", (F.col("starttime") + _seconds(slide_seconds * slides)).alias("endtime"))


def session_counts(df: DataFrame, keys: list[str], time: str, gap: str, name: str) -> DataFrame:
    """keys, count, starttime, endtime of sessions that end after a gap without rows; rows exactly a gap apart are one session."""
    counted = df.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias(name))
    return counted.select(*keys, name, F.col("w.start").alias("starttime"), F.col("w.end").alias("endtime"))


def predicate_sessions(df: DataFrame, keys: list[str], time: str, starts: Column, ends: Column, longest_seconds: int, tie: list[str]) -> DataFrame:
    """df with session_id and session_start, for sessions between predicates.

    A session opens with the first row that meets `starts` while none is open.
    It closes with the first row that meets `ends`, which belongs to it, or
    before a row later than longest_seconds after the one before it. Rows
    outside sessions go. The order is by time, then tie. A group is the events
    of one key, which Spark sorts and streams.
    """
    order = Window.partitionBy(*keys).orderBy(time, *tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    late = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp")) > longest_seconds * 1_000_000
    numbered = df.withColumns({"_s": starts, "_e": ends, "_late": F.coalesce(late, F.lit(False)), "_n": F.row_number().over(order)})
    # runs are cut after each end and before each late row; a session is what follows a run's first start
    cuts = F.coalesce(F.sum(F.when(F.col("_e"), 1).otherwise(0)).over(before), F.lit(0)) + F.sum(F.when(F.col("_late"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.col("_late") | F.coalesce(F.lag("_e").over(order), F.lit(True))
    # all in one order, so that a group is sorted once
    begun = numbered.withColumns({"session_id": cuts, "_cut": cut})
    begun = begun.withColumns({"_run": F.max(F.when(F.col("_cut"), F.col("_n"))).over(order), "_last": F.max(F.when(F.col("_s"), F.col("_n"))).over(before)})
    opens = F.col("_s") & (F.col("_last").isNull() | (F.col("_last") < F.col("_run")))
    begun = begun.withColumn("_open", F.max(F.when(opens, F.struct("_n", time))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = begun.where(F.col("_open._n") >= F.col("_run"))
    return kept.withColumn("session_start", F.col(f"_open.{time}")).drop("_s", "_e", "_late", "_n", "_cut", "_run", "_last", "_open")


def tumbles_touched(time: str, seconds: int) -> Column:
    """The starts of the windows whose closed interval [start, end] holds the time: one, or two on a boundary."""
    start = F.window(time, f"{seconds} seconds").getField("start")
    return F.when(F.col(time) == start, F.array(start, start - F.make_dt_interval(secs=F.lit(seconds)))).otherwise(F.array(start))
