"""Every query against its SQL oracle, at the smallest scale."""

import datetime
from pathlib import Path

import duckdb
import pytest

from gavelstream.plans.catalogue import QUERIES
from gavelstream.plans.oracle import ORACLE_SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.10g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), want.fetchall())


def test_only_processing_time_has_no_oracle():
    assert set(QUERIES) - set(ORACLE_SQL) == {"q12"}


def test_q12_counts_every_bid(spark):
    found = QUERIES["q12"](spark, SF_DIR).collect()
    assert sum(r["bid_count"] for r in found) == 6000


@pytest.mark.parametrize("name", ["q0", "q2", "q20"])
def test_reads_only_the_columns_it_uses(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_shipdate" not in plan
