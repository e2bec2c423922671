"""The registered queries against their SQL."""

import duckdb
import pytest

from tessella.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.ORACLES[name]).df()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    assert sorted(map(tuple, got[names].astype(str).values.tolist())) == sorted(map(tuple, want[names].astype(str).values.tolist()))


def test_all_eleven_are_registered():
    import __spark_entry__

    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted(f"op{i}" for i in range(1, 11))
    assert set(__spark_entry__.queries()) >= {*registry.QUERIES, "pipeline"}
