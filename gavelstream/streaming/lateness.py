"""Late rows by how late they are: within a grace they are taken, beyond it they go to a side output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gavelstream.streaming.sinks import note, noted

TAKEN = ("on time", "in grace")


@dataclass(frozen=True)
class Grace:
    """Deals out a stream's rows by lateness, into one folder for each micro-batch and kind.

    A row is late by what its time lies behind the watermark, which is the
    greatest time of all batches before, less lateness_seconds. Late rows are
    taken up to grace_seconds; those beyond are kept apart, and counted. Rows
    without a time are beyond all grace. Spark's own watermark drops late rows
    unseen; what follows here sets it lateness and grace apart, so that it drops
    none that are taken.
    """

    folder: str
    time: str
    lateness_seconds: int
    grace_seconds: int

    def _one(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if noted(spark, f"{self.folder}/done/{number}") is not None:
            return  # whoever reads the folders has this batch's rows already
        seen = noted(spark, f"{self.folder}/seen/{number - 1}") if number else None
        at = F.unix_micros(self.time)
        behind = F.lit(0) if seen is None else F.lit(seen - self.lateness_seconds * 1_000_000) - at
        kind = F.when(at.isNull(), "beyond").when(behind <= 0, "on time").when(behind <= self.grace_seconds * 1_000_000, "in grace").otherwise("beyond")
        batch.withColumn("lateness", kind).write.mode("overwrite").partitionBy("lateness").parquet(f"{self.folder}/rows/{number}")
        last = batch.agg(F.max(at)).first()[0]
        newest = max((t for t in (seen, last) if t is not None), default=None)
        if newest is not None:
            note(spark, f"{self.folder}/seen/{number}", newest)
        note(spark, f"{self.folder}/done/{number}", number)

    def dealing(self, rows: DataFrame) -> DataStreamWriter:
        """A writer that deals out a stream's micro-batches; one that runs again deals out the same rows once."""
        return rows.writeStream.foreachBatch(self._one)

    def taken(self, spark: SparkSession, schema) -> DataFrame:
        """The rows on time and in grace as a stream, with a watermark behind them all."""
        paths = f"{self.folder}/rows/*/lateness={{{','.join(k.replace(' ', '*') for k in TAKEN)}}}"
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(paths)
        return rows.withWatermark(self.time, f"{self.lateness_seconds + self.grace_seconds} seconds")

    def beyond(self, spark: SparkSession, schema) -> DataFrame:
        """The side output: the rows that came too late."""
        return self._all(spark, schema).where("lateness = 'beyond'").drop("lateness")

    def counts(self, spark: SparkSession, schema) -> DataFrame:
        """lateness, n: rows of each kind so far."""
        return self._all(spark, schema).groupBy("lateness").agg(F.count("*").alias("n"))

    def _all(self, spark: SparkSession, schema) -> DataFrame:
        parts = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/rows")
        kind = F.regexp_extract(F.input_file_name(), "lateness=([^/]*)", 1)
        return parts.withColumn("lateness", F.replace(kind, F.lit("%20"), F.lit(" ")))
