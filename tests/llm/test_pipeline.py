"""The pipeline's stages against brute force, and on odd rows."""

import collections
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from quotary.llm import decontaminate

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import linked, odd_docs  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = (docs.collect(), out.collect())
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    before, after = seen["quality"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in after}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.3 * len(bad)
    before, after = seen["near copies"]
    want = linked([(r["doc_id"], r["text"]) for r in before], 5, 4, 5)
    assert sorted(r["doc_id"] for r in after) == sorted(set(want.values()))
    before, after = seen["benchmark leaks"]
    items = [decontaminate.normal(r["text"].encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leak = {r["doc_id"] for r in before for i in items if decontaminate.distance(i, decontaminate.normal(r["text"].encode()), decontaminate.budget(len(i)))[0] <= decontaminate.budget(len(i))}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leak
    before, after = seen["mixture"]
    times = collections.Counter(r["doc_id"] for r in after)
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 3
    before, after = seen["shards"]
    assert len(before) == len(after) and {r["shard"] for r in after} <= set(range(40))
    whole = P.run(spark, DATA)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, after))


def test_stages_on_odd_rows_and_none(spark):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs.withColumn("score", F.lit("clash")), DATA)
            n = out.count()
            assert n == 0 if docs.isEmpty() else n >= 0
            if name == "near copies" and not docs.isEmpty():
                assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 6, 8]
