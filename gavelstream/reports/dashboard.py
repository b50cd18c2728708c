"""The dashboard's panels and selectors, as queries over the report tables.

results: report_time, case, platform, execution_time, output_size, error.
stats: raw (JSON of one sample of one process), report_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelstream.functions.scalars import json_path


def response_time(results: DataFrame, report_time: str, case: str) -> DataFrame:
    """Execution time per platform of one case in one report."""
    return results.where((F.col("report_time") == report_time) & (F.col("case") == case)).select("platform", "execution_time")


def report_times(results: DataFrame) -> DataFrame:
    return results.select("report_time").distinct()


def cases(results: DataFrame) -> DataFrame:
    return results.select("case").distinct().orderBy("case")


def _samples(stats: DataFrame, report_time: str, case: str, **paths: tuple[str, str]) -> DataFrame:
    """Time, process and the named numbers of the samples of one case in one report."""
    raw = F.col("raw")
    chosen = stats.where((F.col("report_time") == report_time) & json_path(raw, "case", "string").like(f"%{case}%"))
    numbers = [json_path(raw, path, kind).alias(name) for name, (path, kind) in paths.items()]
    return chosen.select(F.to_timestamp(json_path(raw, "read", "string")).alias("time"), json_path(raw, "container_name", "string").alias("container"), *numbers)


def memory_gb(stats: DataFrame, report_time: str, case: str) -> DataFrame:
    found = _samples(stats, report_time, case, usage=("memory_stats.usage", "bigint"))
    return found.select("time", "container", (F.col("usage") / 1024**3).alias("memory_gb"))


def cpu_utilization(stats: DataFrame, report_time: str, case: str) -> DataFrame:
    """The share of the machine's CPU time since the sample before, times its CPUs; null if no time went by."""
    found = _samples(
        stats,
        report_time,
        case,
        total=("cpu_stats.cpu_usage.total_usage", "bigint"),
        total_before=("precpu_stats.cpu_usage.total_usage", "bigint"),
        system=("cpu_stats.system_cpu_usage", "bigint"),
        system_before=("precpu_stats.system_cpu_usage", "bigint"),
        cpus=("cpu_stats.online_cpus", "int"),
    )
    share = F.try_divide((F.col("total") - F.col("total_before")).cast("double"), (F.col("system") - F.col("system_before")).cast("double"))
    return found.select("time", "container", (share * F.col("cpus")).alias("cpu"))


def network_mb(stats: DataFrame, report_time: str, case: str, direction: str) -> DataFrame:
    """Megabytes written (direction "tx") or read ("rx")."""
    if direction not in ("tx", "rx"):
        raise ValueError(f"direction is tx or rx, not {direction}")
    found = _samples(stats, report_time, case, n=(f"networks.eth0.{direction}_bytes", "bigint"))
    return found.select("time", "container", (_number(F.col("n")) / 1024**2).alias("network_mb"))


def _number(value: Column) -> Column:
    return value.cast("double")


def sample_reports(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results and stats tables made from the events table, for trying the queries out."""
    e = events.select(
        F.concat(F.lit("2024010"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("000000")).alias("report_time"),
        F.concat(F.lit("q"), F.col("event_id") % 23).alias("case"),
        F.concat(F.lit("platform-"), F.col("user_id") % 3).alias("platform"),
        "event_id",
        "user_id",
    )
    results = e.where("event_id % 10 = 0").select(
        "report_time", "case", "platform", (F.col("event_id") / 4).alias("execution_time"), F.col("user_id").cast("int").alias("output_size"), F.lit(None).cast("string").alias("error")
    )
    number = {"usage": "event_id * 1048576", "total": "event_id * 1000 + user_id", "before": "event_id * 900", "system": "event_id * 5000 + 7", "sbefore": "event_id * 4000"}
    n = {k: F.expr(v).cast("string") for k, v in number.items()}
    second = F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    raw = F.concat(
        F.lit('{"read":"2024-01-01T00:00:'), second, F.lit('Z","case":"'), F.col("case"), F.lit('","container_name":"'), F.col("platform"),
        F.lit('","memory_stats":{"usage":'), n["usage"], F.lit('},"cpu_stats":{"cpu_usage":{"total_usage":'), n["total"],
        F.lit('},"system_cpu_usage":'), n["system"], F.lit(',"online_cpus":8},"precpu_stats":{"cpu_usage":{"total_usage":'), n["before"],
        F.lit('},"system_cpu_usage":'), n["sbefore"], F.lit('},"networks":{"eth0":{"rx_bytes":'), n["usage"], F.lit(',"tx_bytes":'), n["total"], F.lit("}}}"),
    )
    return results, e.select(raw.alias("raw"), "report_time")
