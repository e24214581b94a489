"""Every registered query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from granary.registry import QUERIES
from granary.sources.driver_tables import SCHEMAS, read_driver_table
from oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
FORBIDDEN = ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    want = _sorted(expected.fetchall(), columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == want
    assert want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]


def test_entry_is_the_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["scenario_code", "total_warehousing_cost"]
    assert df.count() == 3


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_schema_is_the_stored_one(spark, name):
    stored = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    declared = read_driver_table(spark, SF_DIR, name)
    assert declared.dtypes == stored.dtypes
