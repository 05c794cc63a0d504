"""Sources of whole files, requests by a ledger, reviews in rounds, lookups with a cache, emission by the clock."""

import datetime
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from quotary.operators import assembly, chunks
from quotary.sources import tables as S
from quotary.streaming import streams


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_manifests_are_read_by_block(spark):
    at = folder()
    (at / "a.json").write_text(json.dumps({"audio": "x", "blocks": [{"i": 0, "words": [["one", 0, 0.5], ["tw\"o", 0.5, 1]]}, {"i": 1}, {"i": 2, "words": [], "arabic_words": [["three", 2.25, 3]]}]}, indent=1))
    (at / "b.json").write_text("{broken")
    (at / "c.json").write_text(json.dumps({"blocks": [{"i": 5, "words": [["late", None, 1], ["last", 7, None]]}]}))
    got = sorted((Path(r["path"]).name, r["block"], r["pos"], r["word"], r["start"], r["end"]) for r in S.word_manifests(spark, str(at)).collect())
    assert got == [("a.json", 0, 0, "one", 0.0, 0.5), ("a.json", 0, 1, 'tw"o', 0.5, 1.0), ("c.json", 5, 1, "last", 7.0, None)]
    assert [(r["block"], r["word"]) for r in S.word_manifests(spark, str(at), "arabic_words").collect()] == [(2, "three")]


def test_readers_are_cut_at_marks(spark):
    at, line = folder(), "─" * 20
    (at / "r.txt").write_text(f"ANNOTATED READER VIEW\n=====\n\nكلام طيب\n\nGood words\nof two lines\n\nmore\n\nوبعده\n{line}\nكلام فقط\n{line}─\nhalf نصف\n\nكلام\n\n{line}\n\n")
    got = [(r["block"], r["script"], r["other"]) for r in S.reader_blocks(spark, str(at)).orderBy("block").collect()]
    assert got == [(0, "كلام طيب وبعده", "Good words\nof two lines\n\nmore")]
    assert S.reader_blocks(spark, str(at), share=0.45).count() == 2


def test_readers_need_no_file_each(spark, monkeypatch):
    from quotary.plans import runs

    at, data = folder() / "readers", folder()
    monkeypatch.setattr(runs, "_place", lambda spark, name: str(at))
    said = ["zzzz zzzz\n\nabcd", "abcd\nabcd zz", "", None]
    rows = [(c, t, said[(c + t) % 4]) for c in range(300) for t in range(4)] + [(None, 0, "abcd\nzzzz")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{data}/conversations.parquet")
    got = {(r["conv_id"], r["block"]) for r in runs.read_blocks(spark, str(data)).collect()}
    assert {c for c, _ in got} == {*range(300), None} and len(list(at.rglob("part-*"))) <= 64


def test_long_readers_stay_whole(spark):
    at, n = str(folder() / "long"), 21_000_000
    rows = spark.range(1).select(F.lit("r").alias("path"), F.concat(F.lit("abcd"), F.repeat(F.lit(" "), n), F.lit("\n\nzzzz")).alias("text"))
    S.append_json_lines(rows, at)
    assert S.json_lines(spark, at, "path string, text string").select(F.length("text")).first()[0] == n + 10


def test_requests_are_planned_once(spark):
    rows = spark.createDataFrame([("a", i, f"text {i}") for i in range(8)] + [("a", 9, None), ("b", 0, "text 0")], "run string, i int, t string")
    plan = lambda ledger, cap=10.0: sorted(tuple(r) for r in chunks.requests(rows, spark.createDataFrame(ledger, "hash string, state string, cost double"), "run", "i", "t", model="m", cap=cap, price=(1e6, 0.0), out=0, size=3).select("run", "first", "last", "n", "worst", "allowed").collect())
    name = {r["i"]: r["h"] for r in rows.where("run = 'a' and t is not null").select("i", chunks.request_hash(F.col("t"), "m").alias("h")).collect()}
    assert plan([], 1e9) == [("a", 0, 2, 3, 18.0, True), ("a", 3, 5, 3, 18.0, True), ("a", 6, 7, 2, 12.0, True), ("b", 0, 0, 1, 6.0, True)]
    done = [(name[i], "done", 1.0) for i in (0, 1, 4)]
    assert plan([*done, (name[2], "failed", 2.0), (name[1], "failed", 0.5)], 29.0) == [("a", 2, 2, 1, 6.0, True), ("a", 3, 3, 1, 6.0, True), ("a", 5, 7, 3, 18.0, False)]
    assert plan([(h, "done", 0.0) for h in name.values()]) == []


def test_reviews_go_on_where_something_changed(spark):
    long = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, i, f"{w} {long}") for i, w in enumerate(["red", "green", "blue", "grey"])], "d int, i int, t string")
    fix = [(1, 0, 1, f"scarlet {long}", "high"), (1, 1, 1, f"{long} {long}", "high"), (1, 2, 1, f"navy {long}", "low"), (1, 3, 1, f"grey {long}", "high"), (1, 0, 2, f"crimson {long}", "mid"), (1, 1, 2, f"emerald {long}", "high"), (1, 0, 3, f"pink {long}", "high")]
    texts, log = assembly.reviewed(rows, spark.createDataFrame(fix, "d int, i int, round int, fix string, severity string"), "d", "i", "t")
    assert [r["t"].split()[0] for r in texts.orderBy("i").collect()] == ["crimson", "green", "blue", "grey"] and texts.columns == rows.columns
    assert sorted((r["round"], r["i"], r["verdict"]) for r in log.collect()) == [(1, 0, "applied"), (1, 1, "length"), (1, 2, "low"), (1, 3, "same"), (2, 0, "applied")]
    assert assembly.reviewed(rows, spark.createDataFrame([], "d int, i int, round int, fix string, severity string"), "d", "i", "t")[1].count() == 0


def test_lookups_are_known_for_a_while(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=s), a, ok) for i, (s, a, ok) in enumerate([(0, "x", True), (1, "x", True), (2, "y", False), (3, "y", True), (4, "z", True), (5, "y", True), (61, "z", True), (62, "x", True), (100, "x", True), (163, "x", True)])]
    at = folder()
    spark.createDataFrame(rows, "event_id int, ts timestamp, a string, found boolean").coalesce(1).write.parquet(str(at / "in"))
    stream = streams.events(streams.with_disk_state(spark), str(at / "in"))
    got = streams.run_to_end(streams.lookups(stream, "a", "found", most=3, span=60, keep=100), "append").orderBy("event_id").collect()
    assert [r["verdict"] for r in got] == ["looked up", "known", "looked up", "looked up", "refused", "known", "looked up", "known", "looked up", "known"]


def test_a_report_is_sent_and_saved_by_the_clock(spark):
    at, sent, saved = folder(), [], []
    spark.range(10).selectExpr("cast(id as int) event_id").write.parquet(str(at / "in"))
    counts = spark.readStream.schema("event_id int").parquet(str(at / "in")).groupBy().count()
    query = streams.emit(counts, "complete", lambda b: sent.append(b.first()["count"]), lambda b: saved.append(b.first()["count"]), every=0.2, saved=600)
    try:
        query.processAllAvailable()
        spark.range(5).selectExpr("cast(id as int) event_id").write.mode("append").parquet(str(at / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sent[0] == 10 and sent[-1] == 15 and saved == [10]
