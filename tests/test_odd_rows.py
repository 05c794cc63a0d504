"""Queries against their SQL on rows in which engines differ: halves, letters beyond ASCII, words cut short by them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.plans import registry
from tests.test_oracles import rows

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa école garçon"
TABLES = {
    "documents": ("doc_id long, text string, lang string", [(1, "Inés went", "en"), (2, "In town", "en"), (3, "thé noir", "fr"), (4, "The end straßenßa", "en"), (5, "it_is", "en"), (6, f"one two three {PASSAGE[:-13]} ecole garcon more", "en")]),
    "benchmark": ("item_id long, text string", [(1, PASSAGE), (2, "straßenßa straßenß")]),
    "conversations": ("conv_id long, turn long, role string, text string", [(1, 1, "user", "désorry"), (1, 2, "user", "so sorry"), (1, 3, "user", "sorryé")]),
    "events": ("event_id long, user_id long, event_type string, value double", [(i, i, "view", v) for i, v in enumerate((59.0, 63.0, 69.0, 75.0, 599.0, 600.0, 630.0, 690.0, 3750.0, 3751.0))]),
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, data) in TABLES.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["openers", "note_turns", "shown_shares", "term_rules", "label_faults"])
def test_odd_rows_equal_sql(spark, odd, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    got = rows(registry.QUERIES[name](spark, odd).toPandas())
    assert got == rows(c.execute(registry.SQL[name]).df())


def test_durations_round_half_up(spark):
    given = [(75.0, "1.3 min"), (69.0, "1.1 min"), (63.0, "1.1 min"), (599.0, "10.0 min"), (630.0, "11 min"), (3750.0, "63 min"), (3749.0, "62 min"), (59.0, "59 s"), (None, "–")]
    got = spark.createDataFrame(given, "s double, want string").withColumn("got", X.duration(F.col("s"))).collect()
    assert [r["got"] for r in got] == [w for _, w in given]
