"""Put report files into the tables that the dashboard reads."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream import schemas

_NAME = re.compile(r"report_(.+)\.csv")


def report_times(folder: str) -> list[str]:
    """Times of the reports in a local folder, earliest first."""
    return sorted(m[1] for p in Path(folder).iterdir() if (m := _NAME.fullmatch(p.name)))


def latest_report(folder: str) -> str:
    times = report_times(folder)
    if not times:
        raise FileNotFoundError(f"no report_<time>.csv in {folder}")
    return times[-1]


def read_report(spark: SparkSession, folder: str, report_time: str) -> tuple[DataFrame, DataFrame]:
    """results and stats of one report, as the dashboard's tables have them."""
    columns = schemas.RESULT_REPORT
    from_file = schemas.T.StructType([f for f in columns if f.name != "report_time"])
    results = spark.read.schema(from_file).option("header", True).csv(f"{folder}/report_{report_time}.csv")
    results = results.withColumn("report_time", F.lit(report_time)).select(*columns.names)
    stats = spark.read.text(f"{folder}/stats_report_{report_time}.json").select(F.col("value").alias("raw"), F.lit(report_time).alias("report_time"))
    return results, stats


def load_report(spark: SparkSession, folder: str, tables: str, report_time: str | None = None) -> str:
    """Append a report, the latest if none is named, to the tables results and stats; each line goes in once."""
    report_time = report_time or latest_report(folder)
    for name, rows in zip(("results", "stats"), read_report(spark, folder, report_time)):
        rows.write.mode("append").parquet(f"{tables}/{name}")
    return report_time
