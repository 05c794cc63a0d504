"""Every query of the engine's own operators against its DuckDB SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from quotary.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float) and x == int(x):
        return int(x)
    if isinstance(x, datetime.datetime):
        return x.date().isoformat() if x.time() == datetime.time(0) else x.isoformat()
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows(df):
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries that are cheap enough to be held against their SQL on more rows too.
MORE = "lost_runs heard_in_order anchored_words word_times recited_words line_narrators chain_order bodies_said term_rules contained_lines stitched_windows settled_claims broken_off read_blocks planned_requests review_rounds guarded_reviews checked_views engagement_kept checked_entries terms_without_source increasing_times person_shifts restarts best_passage".split()


@pytest.mark.parametrize("name", MORE)
def test_query_equals_its_sql_on_more_rows(spark, name):
    larger, c = DATA.replace("0.001", "0.01"), duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, larger).toPandas()) == rows(c.execute(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_flagship_finds_the_planted_passages(spark):
    got = registry.QUERIES["quoted_passages"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 26 and sum(r["hits"] for r in got) == 982
