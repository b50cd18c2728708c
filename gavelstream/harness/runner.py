"""Run cases one after another, each in a session of its own, and report."""

from __future__ import annotations

import argparse
import csv
import json
import signal
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gavelstream.harness.config import BenchmarkError, CaseResult, RunConfig, load_config
from gavelstream.harness.generator import generate, paced, split_events
from gavelstream.harness.sampler import Sampler
from gavelstream.plans import catalogue
from gavelstream.sources.auction_tables import Market, read_market
from gavelstream.streaming import queries as streams
from gavelstream.streaming.market import stream_market, watermarked, with_instants, write_market
from gavelstream.streaming.replay import work_folder
from gavelstream.streaming.sinks import merging, remove
from gavelstream.streaming.state import use_rocksdb

MODES = ("batch", "stream")
FIELDS = ("case", "platform", "execution_time", "output_size", "error")


@contextmanager
def session(config: RunConfig) -> Iterator[SparkSession]:
    """A session that is stopped, with its streams, however the case ends."""
    spark = SparkSession.builder.config(map=config.spark_conf()).appName("gavelstream").getOrCreate()
    try:
        yield spark
    finally:
        for query in spark.streams.active:
            query.stop()
        spark.stop()


def _market(spark: SparkSession, config: RunConfig, sf_dir: str | None) -> Market:
    return read_market(spark, sf_dir) if sf_dir else generate(spark, config.data_size, config.generators)


def make_rows(df: DataFrame) -> int:
    """Make all columns of df, and say how many rows there are; a bare count would drop the columns that it does not need."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get.get("rows", 0)


def run_batch(spark: SparkSession, case: str, config: RunConfig, sf_dir: str | None) -> int:
    """Rows of a case; the whole result is made."""
    if case not in catalogue.QUERIES:
        raise BenchmarkError(f"there is no case {case}")
    if sf_dir:
        return make_rows(catalogue.QUERIES[case](spark, sf_dir))
    market = generate(spark, config.data_size, config.generators)
    query = catalogue.MARKET_QUERIES.get(case)
    if query is None:
        raise BenchmarkError(f"{case} needs a folder of tables")
    return make_rows(query(market))


def _paced_market(spark: SparkSession, config: RunConfig) -> Market:
    generated = split_events(paced(spark, config.data_size, config.event_rate, config.generators))
    return Market(*[watermarked(with_instants(getattr(generated, kind))) for kind in ("person", "auction", "bid")])


def _run_to_the_end(writer: DataStreamWriter, config: RunConfig, is_paced: bool) -> None:
    """Until the input has ended: with a second for each batch if it is paced."""
    if not is_paced:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query, last = writer.trigger(processingTime="1 second").start(), -(-config.data_size // config.event_rate)
    while not query.awaitTermination(0.2):
        if (query.lastProgress or {"batchId": -1})["batchId"] >= last:  # the first batch has no rows yet
            query.stop()


def run_stream(spark: SparkSession, case: str, config: RunConfig, sf_dir: str | None) -> int:
    """Rows that a case's stream emits, or of the table it ends with, over the data as it comes in files or at a rate."""
    if not any(case in kind for kind in (streams.DIRECT, streams.PER_BATCH, streams.MERGED)):
        raise BenchmarkError(f"{case} does not run as a stream")
    use_rocksdb(spark)
    folder = work_folder(spark, f"case-{case}")
    try:
        return _stream_in(folder, spark, case, config, sf_dir)
    finally:
        remove(spark, folder)


def _stream_in(folder: str, spark: SparkSession, case: str, config: RunConfig, sf_dir: str | None) -> int:
    is_paced = config.paced and not sf_dir
    market = _paced_market(spark, config) if is_paced else stream_market(spark, **write_market(_market(spark, config, sf_dir), f"{folder}/in"))
    if case not in streams.MERGED:
        query, mode = streams.DIRECT.get(case) or (streams.PER_BATCH[case][0], "append")
        finish = streams.PER_BATCH[case][1] if case in streams.PER_BATCH else lambda batch: batch
        rows = 0

        def count(batch, number: int) -> None:
            nonlocal rows
            rows += make_rows(finish(batch))

        _run_to_the_end(query(market).writeStream.outputMode(mode).foreachBatch(count).option("checkpointLocation", f"{folder}/checkpoint"), config, is_paced)
        return rows
    merged, last = streams.MERGED[case], []
    table = merged.table(f"{folder}/table")
    writer = merging(merged.changes(market), table, merged.partial, lambda _, n: last.append(n)).option("checkpointLocation", f"{folder}/checkpoint")
    _run_to_the_end(writer, config, is_paced)
    return make_rows(merged.result(table.version(spark, last[-1]))) if last else 0


def run_case(case: str, mode: str, config: RunConfig, sf_dir: str | None = None) -> CaseResult:
    """One case in one mode; only the query is timed."""
    with Sampler(case, mode, config.stats_interval) as sampler:
        began = time.time()
        try:
            with session(config) as spark:
                spark.streams.addListener(sampler.progress)
                began = time.time()
                rows = (run_batch if mode == "batch" else run_stream)(spark, case, config, sf_dir)
                took = time.time() - began
            result = CaseResult(case, mode, took, rows)
        except Exception as error:  # a case that fails does not end the suite
            result = CaseResult(case, mode, time.time() - began, 0, f"{type(error).__name__}: {str(error)[:300]}")
    result.stats = sampler.samples
    return result


def save_results(results: list[CaseResult], folder: str, stamp: str) -> tuple[Path, Path]:
    """report_<time>.csv and stats_report_<time>.json (one JSON object per line)."""
    report, stats = Path(folder, f"report_{stamp}.csv"), Path(folder, f"stats_report_{stamp}.json")
    with report.open("w", newline="") as file:
        writer = csv.DictWriter(file, fieldnames=FIELDS)
        writer.writeheader()
        writer.writerows(r.row() for r in results)
    stats.write_text("".join(json.dumps(s) + "\n" for r in results for s in r.stats or []))
    return report, stats


def summary(results: list[CaseResult]) -> str:
    lines = [f"{'case':<18}{'mode':<10}{'seconds':>10}{'rows':>12}  status"]
    lines += [f"{r.case:<18}{r.platform:<10}{r.execution_time:>10.2f}{r.output_size:>12}  {'FAILED ' + r.error if r.error else 'PASSED'}" for r in results]
    return "\n".join(lines)


def chosen_cases(cases: str, modes: list[str], skipped: list[str]) -> list[tuple[str, str]]:
    """The cases with their modes, in order; "suite" stands for every case of a mode but those skipped."""
    known = {"batch": list(catalogue.MARKET_QUERIES), "stream": [*streams.DIRECT, *streams.PER_BATCH, *streams.MERGED]}
    if cases.strip() == "suite":
        return [(case, mode) for mode in modes for case in known[mode] if case not in skipped]
    return [(case.strip(), mode) for case in cases.split(",") for mode in modes]


def main(arguments: list[str] | None = None) -> int:
    """Exit code 1 if any case failed."""
    parser = argparse.ArgumentParser(description="Run benchmark cases and write reports.")
    parser.add_argument("--cases", default="base", help="cases, comma-separated; suite: all that a mode can run")
    parser.add_argument("--skip", default="", help="cases to leave out of a suite, comma-separated")
    parser.add_argument("--platforms", default="batch", help="modes, comma-separated: batch, stream")
    parser.add_argument("--data-size", type=int, help="events to generate")
    parser.add_argument("--event-rate", type=int, help="events a second: streams of generated events come at this rate")
    parser.add_argument("--config-file", help="settings in JSON")
    parser.add_argument("--cpu-cores", type=float)
    parser.add_argument("--memory-limit")
    parser.add_argument("--tables", help="folder of tables to run over instead of generated events")
    parser.add_argument("--output", default=".", help="folder for the reports")
    given = parser.parse_args(arguments)
    for kind in (signal.SIGTERM, signal.SIGINT):  # the running case's session ends on the way out
        signal.signal(kind, lambda *_: sys.exit(1))
    try:
        config = load_config(given.config_file, vars(given) | {"paced": True if given.event_rate else None})
        modes = [m.strip() for m in given.platforms.split(",")]
        if unknown := set(modes) - set(MODES):
            raise BenchmarkError(f"unknown modes: {', '.join(sorted(unknown))}")
    except BenchmarkError as error:
        print(error, file=sys.stderr)
        return 1
    skipped = [c.strip() for c in given.skip.split(",")]
    results = [run_case(case, mode, config, given.tables) for case, mode in chosen_cases(given.cases, modes, skipped)]
    save_results(results, given.output, datetime.now().strftime("%Y%m%d%H%M%S"))
    print(summary(results))
    return int(any(r.error for r in results))


if __name__ == "__main__":
    sys.exit(main())
