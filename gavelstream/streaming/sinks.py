"""Where streaming results go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def start(result: DataFrame, checkpoint: str, mode: str = "append", kind: str = "noop", path: str | None = None, name: str | None = None, partitions: tuple[str, ...] = (), once: bool = True, **options: str) -> StreamingQuery:
    """Start a query into a sink: noop, memory, parquet, json, csv or kafka.

    A query's checkpoint is its own, and with it its place in the sources. With
    once it takes what there is and ends.
    """
    writer = result.writeStream.outputMode(mode).format(kind).option("checkpointLocation", checkpoint).options(**options)
    if name:
        writer = writer.queryName(name)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def start_partitioned(result: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Files laid out by day and minute."""
    return start(result, checkpoint, kind="parquet", path=path, partitions=("dt", "hm"))


def upsert_messages(result: DataFrame, keys: list[str]) -> DataFrame:
    """Rows as keyed messages, key and value in JSON, for a compacted topic."""
    return result.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct("*")).alias("value"))


def noted(spark: SparkSession, path: str) -> int | None:
    """The greatest number written at a path, if any."""
    try:
        return spark.read.schema("n long").json(path).agg(F.max("n")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def note(spark: SparkSession, path: str, number: int) -> None:
    spark.range(1).select(F.lit(number).alias("n")).coalesce(1).write.mode("append").json(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write one."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _runs(number: int) -> list[int]:
    """The runs that make up a table after batch `number` (counted from 1): each ends there and covers as many batches as its lowest bit says."""
    found = []
    while number > 0:
        found.append(number)
        number -= number & -number
    return found


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row per key that micro-batches are merged into.

    A batch writes one run: its own rows, merged with the runs that it ends, as
    a binary counter carries. A row is so written again about as often as the
    number of batches has bits, and never with all that came before; the table
    is the merge of at most that many runs. A batch that is run again after a
    failure starts from runs before it and writes its own anew, so it counts
    once. Runs that no later table reads are cleared two batches on (clear).
    """

    folder: str
    keys: tuple[str, ...]
    merge: tuple[Column, ...]

    def _merged(self, spark: SparkSession, runs: list[int], schema, *more: DataFrame) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        parts = [*more, *([reader.parquet(*[f"{self.folder}/run{r}" for r in runs])] if runs else [])]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy(*self.keys).agg(*self.merge)

    def version(self, spark: SparkSession, number: int, schema=None) -> DataFrame:
        """The table after the batch of this number (counted from 0)."""
        return self._merged(spark, _runs(number + 1), schema)

    def upsert(self, rows: DataFrame, number: int) -> DataFrame:
        """Merge rows, which hold the keys and the merged columns, as the batch of this number; the table then."""
        spark, last = rows.sparkSession, number + 1
        ended = [r for r in _runs(number) if r > last - (last & -last)]
        self._merged(spark, ended, rows.schema, rows).write.mode("overwrite").parquet(f"{self.folder}/run{last}")
        return self.version(spark, number, rows.schema)

    def clear(self, spark: SparkSession, number: int) -> None:
        """Delete the runs that neither the table after this batch nor the one before it is made of."""
        for run in {*_runs(number - 1)} - {*_runs(number), *_runs(number + 1)}:
            remove(spark, f"{self.folder}/run{run}")


@dataclass(frozen=True)
class TopTable:
    """The n first rows of a table whose rows only ever rise in the order, such as counts.

    A row outside the first n that does not change cannot enter them, as those
    before it rise or stay: the table after a batch is the first n of the table
    before it and of the batch's rows. A batch costs n rows and its own, and
    one that is run again starts from the same table.
    """

    folder: str
    keys: tuple[str, ...]
    merge: tuple[Column, ...]
    order: tuple[Column, ...]
    n: int

    def version(self, spark: SparkSession, number: int, schema=None) -> DataFrame:
        """The table after the batch of this number (counted from 0)."""
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(f"{self.folder}/top{number}")

    def upsert(self, rows: DataFrame, number: int) -> DataFrame:
        """Take in rows, which hold the keys and the merged columns, as the batch of this number; the table then."""
        spark = rows.sparkSession
        both = rows.unionByName(self.version(spark, number - 1, rows.schema)) if number else rows
        first = both.groupBy(*self.keys).agg(*self.merge).orderBy(*self.order).limit(self.n)
        first.select(rows.columns).write.mode("overwrite").parquet(f"{self.folder}/top{number}")
        return self.version(spark, number, rows.schema)

    def clear(self, spark: SparkSession, number: int) -> None:
        """Delete the table from two batches before this one."""
        if number > 1:
            remove(spark, f"{self.folder}/top{number - 2}")


def merging(changes: DataFrame, table: KeyedTable | TopTable, partial: Callable[[DataFrame], DataFrame], then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that merges a stream's micro-batches, reduced by `partial`, into a table; then gets the table after each."""

    def one(batch: DataFrame, number: int) -> None:
        merged = table.upsert(partial(batch), number)
        if then:
            then(merged, number)
        table.clear(batch.sparkSession, number)

    return changes.writeStream.foreachBatch(one)


def start_merging(changes: DataFrame, table: KeyedTable | TopTable, partial: Callable[[DataFrame], DataFrame], checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Merge what there is, and end."""
    return merging(changes, table, partial, then).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
