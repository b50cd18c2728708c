"""Settings, cases, reports, sources and the entry module."""

import json
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelstream import schemas
from gavelstream.harness.config import BenchmarkError, CaseResult, RunConfig, load_config
from gavelstream.harness.generator import generate
from gavelstream.harness.runner import chosen_cases, make_rows, run_batch, run_stream, save_results, summary
from gavelstream.harness.sampler import Sampler
from gavelstream.reports import dashboard
from gavelstream.reports.loader import latest_report, load_report
from gavelstream.sources.readers import Source, decode_json, decode_keyed, from_raw, table_of_changes, with_declared_names

REPO = Path(__file__).parents[1]


def test_settings_precedence(tmp_path):
    file = tmp_path / "settings.json"
    file.write_text(json.dumps({"cpu_cores": 4, "data_size": 5, "unknown": 1}))
    config = load_config(str(file), {"cpu_cores": 1.5, "data_size": None})
    assert (config.cpu_cores, config.data_size, config.paced) == (1.5, 5, False)
    assert RunConfig().spark_conf()["spark.master"] == "local[2]"
    with pytest.raises(BenchmarkError):
        load_config(str(tmp_path / "none.json"), {})


def test_generator_is_deterministic(spark):
    one, two = generate(spark, 500), generate(spark, 500, generators=5)
    for name in ("person", "auction", "bid"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(two, name).collect()))
    assert (one.person.count(), one.auction.count(), one.bid.count()) == (10, 30, 460)


@pytest.mark.parametrize("case", ["q0", "q4", "q8", "q19"])
def test_generated_cases(spark, case):
    assert run_batch(spark, case, RunConfig(data_size=2000), None) > 0


def test_streamed_case(spark):
    assert run_stream(spark, "q2", RunConfig(data_size=2000), "/root/testdata/sf0.001") == 37
    with pytest.raises(BenchmarkError):
        run_stream(spark, "asof_join", RunConfig(), None)
    with pytest.raises(BenchmarkError):
        run_batch(spark, "q999", RunConfig(), None)


@pytest.mark.parametrize("case", ["q2", "q106"])
def test_paced_streams_keep_their_rate(spark, case):
    began = time.time()
    config = RunConfig(data_size=2000, event_rate=700, paced=True)
    assert run_stream(spark, case, config, None) == run_batch(spark, case, config, None)
    assert time.time() - began > 2


def test_a_suite_leaves_out_what_it_is_told_to():
    chosen = chosen_cases("suite", ["batch", "stream"], ["q6", "q13"])
    assert ("q4", "batch") in chosen and ("q4", "stream") in chosen and not {"q6", "q13"} & {case for case, _ in chosen}
    assert chosen_cases("q1, q2", ["batch"], []) == [("q1", "batch"), ("q2", "batch")]


def test_all_columns_are_made(spark):
    failing = spark.range(3).selectExpr("id", "if(id = 1, raise_error('made'), 'x') AS body")
    assert failing.count() == 3
    with pytest.raises(Exception, match="made"):
        make_rows(failing)
    assert make_rows(spark.range(5)) == 5 and make_rows(spark.range(5).where("id > 9")) == make_rows(spark.range(5).where("false")) == 0


def test_reports_round_trip(spark, tmp_path):
    with Sampler("q1", "batch", 0.05) as sampler:
        sum(range(10**6))
    results = [CaseResult("q1", "batch", 1.5, 10, None, sampler.samples), CaseResult("q2", "batch", 0.1, 0, "no")]
    save_results(results, str(tmp_path), "20240101000000")
    assert latest_report(str(tmp_path)) == "20240101000000"
    load_report(spark, str(tmp_path), str(tmp_path / "tables"))
    found, stats = spark.read.parquet(str(tmp_path / "tables/results")), spark.read.parquet(str(tmp_path / "tables/stats"))
    assert found.columns == schemas.RESULT_REPORT.names and found.count() == 2
    assert stats.count() == len(sampler.samples)
    assert dashboard.memory_gb(stats, "20240101000000", "q1").first()["memory_gb"] > 0
    assert dashboard.cpu_utilization(stats, "20240101000000", "q1").count() == len(sampler.samples)
    assert "FAILED" in summary(results) and "PASSED" in summary(results)


def test_other_producers_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "item_name": "x", "date_time": "2024-01-01 00:00:01.500"}\n')
    raw = Source("raw", str(tmp_path)).read(spark, schemas.auction())
    row = from_raw(raw, schemas.auction()).first()
    assert row["id"] == 1 and row["itemName"] is None and row["date_time"].microsecond == 500_000
    renamed = with_declared_names(spark.createDataFrame([(1, "x")], "id long, item_name string"), "auction")
    assert renamed.columns == ["id", "itemName"]
    message = spark.createDataFrame([(bytearray(b'{"key": 3, "value": "v"}'),)], "value binary")
    assert tuple(decode_json(message, schemas.SIDE_INPUT).first()) == (3, "v")
    (tmp_path / "side").mkdir()
    (tmp_path / "side/s.csv").write_text("5,v5\n")
    assert tuple(Source("csv", str(tmp_path / "side")).read(spark, schemas.SIDE_INPUT).first()) == (5, "v5")


def test_recorded_messages(spark):
    """Frames as a broker gives them: values, a broken one, a missing one, a deletion."""
    frames = [(b'{"key": 1}', b'{"key": 1, "value": "a"}', 1), (b'{"key": 2}', b'{"key": 2, "value": "b"}', 2), (b'{"key": 1}', b'{"key": 1, "value": "c"}', 3), (b'{"key": 2}', None, 4), (b'{"key": 3}', b"{broken", 5)]
    messages = spark.createDataFrame([(bytearray(k), bytearray(v) if v else None, t) for k, v, t in frames], "key binary, value binary, at long").withColumn("timestamp", F.timestamp_seconds("at"))
    plain = [tuple(r) for r in decode_json(messages.orderBy("at"), schemas.SIDE_INPUT).collect()]
    assert plain == [(1, "a"), (2, "b"), (1, "c"), (None, None), (None, None)]
    changes = decode_keyed(messages, T.StructType(schemas.SIDE_INPUT.fields[:1]), schemas.SIDE_INPUT)
    assert [r["deleted"] for r in changes.orderBy("message_time").collect()] == [False, False, False, True, False]
    assert sorted(map(tuple, table_of_changes(changes, "key").collect())) == [(1, "c"), (3, None)]


def test_entry_without_the_corpus_parts():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['gavelstream.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'q4' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_stream_progress_is_sampled(spark, tmp_path):
    for number in range(2):
        spark.range(10 * (number + 1)).selectExpr("id % 3 AS k").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    counted = spark.readStream.schema("k long").option("maxFilesPerTrigger", "1").json(str(tmp_path / "in")).groupBy("k").count()
    with Sampler("count", "stream", 0.05) as sampler:
        spark.streams.addListener(sampler.progress)
        counted.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # progress comes in a thread of its own
            if sampler.progress.last and sampler.progress.last["input_rows"] == 30:
                break
            time.sleep(0.1)
    spark.streams.removeListener(sampler.progress)
    last = sampler.samples[-1]["streams"]
    assert last["input_rows"] == 30 and last["state_rows"] == 3 and last["late_rows"] == 0 and last["batch_ms"] > 0
