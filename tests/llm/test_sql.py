"""Every training-data query that has SQL against it, on the smallest tables."""

import importlib.util
import pathlib

import duckdb
import pytest

from quotary.llm import registry

DATA = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("oracle_rows", pathlib.Path(__file__).parents[1] / "test_oracles.py")
oracles = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracles)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in oracles.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), c.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and oracles.rows(got) == oracles.rows(want)
