"""The three streams with their watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream import schemas
from gavelstream.sources.auction_tables import Market, event_time, split_union
from gavelstream.sources.readers import Source, with_declared_names

#: How late a row may come.
LATENESS = "4 seconds"


def watermarked(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return stream.withWatermark("date_time", lateness)


#: Rows of a file that write_market writes, about; a part of more is several files, written by as many tasks.
FILE_ROWS = 100_000


def stream_market(spark: SparkSession, person: Source | None = None, auction: Source | None = None, bid: Source | None = None, lateness: str = LATENESS) -> Market:
    """Streams of the three kinds, each from its own place; None where there is none."""
    kinds = {"person": person, "auction": auction, "bid": bid}
    streams = dict.fromkeys(kinds)
    for name, source in kinds.items():
        if source is None:
            continue
        rows = source.stream(spark, getattr(schemas, name)())
        streams[name] = watermarked(with_declared_names(rows, name), lateness)
    return Market(**streams)


def stream_union(spark: SparkSession, source: Source, lateness: str = LATENESS) -> Market:
    """Streams of the three kinds out of one tagged-union stream, with one watermark on its common event time."""
    events = event_time(source.stream(spark, schemas.union_event())).withWatermark("dateTime", lateness)
    return split_union(events)


def with_instants(table: DataFrame) -> DataFrame:
    """Event times as TIMESTAMP, read in the session's time zone (UTC), as watermarks need them."""
    times = [c for c in ("date_time", "expires") if c in table.columns]
    return table.withColumns({c: F.col(c).cast("timestamp") for c in times})


def write_market(market: Market, folder: str, files: int = 4, kind: str = "parquet", names: tuple[str, ...] = ("person", "auction", "bid")) -> dict[str, Source]:
    """Batch tables as folders that streams can read: event times as TIMESTAMP (UTC), in order of time over `files` parts.

    Parts are written one after the other, as a stream takes files in the order
    of their writing, and a micro-batch takes one part. A part is one file in
    order of time, or of a large table as many as there are tasks to write it,
    dealt by their values, which unlike dealing in turn needs no sort.
    """
    places = {}
    for name in names:
        table = with_instants(getattr(market, name))
        at = F.unix_micros("date_time")
        # counted and cut in one pass
        found = table.agg(F.count("*").alias("n"), F.approx_percentile(at, [n / files for n in range(1, files)], 1000).alias("bounds") if files > 1 else F.lit(None).alias("bounds")).first()
        bounds, tasks = found["bounds"] or [], max(1, found["n"] // (files * FILE_ROWS))
        place = f"{folder}/{name}"
        for number, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
            part = table.where(F.lit(True) if low is None else at > low).where(F.lit(True) if high is None else at <= high)
            dealt = part.coalesce(1).sortWithinPartitions("date_time") if tasks == 1 else part.repartition(tasks, *part.columns)
            dealt.write.mode("append" if number else "overwrite").format(kind).save(place)
            # a micro-batch would fill up with files of the next part, and its watermark pass that part's others
            for _ in range((number + 1) * tasks - _n_files(table.sparkSession, place)):
                part.limit(0).coalesce(1).write.mode("append").format(kind).save(place)
        places[name] = Source(kind, place, {"maxFilesPerTrigger": str(tasks)})
    return places


def _n_files(spark: SparkSession, place: str) -> int:
    return len(spark.read.format("binaryFile").load(place).inputFiles())
