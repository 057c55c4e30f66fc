"""Every registered query against its SQL twin, with chunks so small that keys span many of them."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from packetloom.plans.catalog import load

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SQL = {name: text for name, text in entry_points.oracle_sql().items() if name in load()}
QUERIES = {name: job for name, job in entry_points.queries().items() if name in load()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def tiny_chunks(spark):
    spark.conf.set("packetloom.chunkRows", "16")
    yield
    spark.conf.unset("packetloom.chunkRows")


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return None if math.isnan(value) else float(f"{float(value):.12g}")


def rows(frame):
    ordered = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in row) for row in ordered.itertuples(index=False, name=None)),
                  key=repr)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    found = QUERIES[name](spark, DATA).toPandas()
    expected = duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_entry_gives_rows(spark):
    assert entry_points.entry(spark).count() > 0
