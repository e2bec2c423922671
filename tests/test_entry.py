"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tessella import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    return sorted(map(tuple, frame[names].astype(str).values.tolist()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(queries.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
