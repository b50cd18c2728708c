"""Joins of a stream with a table as it is when a micro-batch runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from gavelstream.streaming.sinks import note, noted


@dataclass(frozen=True)
class VersionedTable:
    """A table that is replaced as a whole, under a new version each time.

    A version is written first and noted then, so that none is read half
    written; old versions stay, for micro-batches that run again.
    """

    folder: str

    def publish(self, rows: DataFrame) -> int:
        """Make rows the newest version; its number, from 1."""
        spark = rows.sparkSession
        number = (self.newest(spark) or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{number}")
        note(spark, f"{self.folder}/versions", number)
        return number

    def newest(self, spark: SparkSession) -> int | None:
        return noted(spark, f"{self.folder}/versions")

    def version(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/v{number}")


def joining(rows: DataFrame, side: VersionedTable, join: Callable[[DataFrame, DataFrame], DataFrame], ledger: str, then: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that joins each micro-batch with the side's newest version, and hands the result on with the batch's number.

    The version that a batch took is noted in the folder `ledger`, one for each
    query, before it is used: a batch that runs again sees the version that it
    saw before, and a change between two batches is seen by the second only.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = noted(spark, f"{ledger}/{number}")
        if version is None:
            version = side.newest(spark)
            if version is None:
                raise ValueError(f"{side.folder} has no version yet")
            note(spark, f"{ledger}/{number}", version)
        then(join(batch, side.version(spark, version)), number)

    return rows.writeStream.foreachBatch(one)
