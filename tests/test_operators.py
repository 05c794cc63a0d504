"""Edge cases of operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import audience, audit, catalog, chunks, refs, spans, timing
from quotary.sources import tables


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("بِسْمِ اللَّهِ", "بسم الله"), ("ينفعه؟", "ينفعه"), ("﴿لئن﴾", "لئن"), ("أإآٱ", "اااا"), ("ـكـ", "ك"), ("ذٰلك", "ذالك")],
)
def test_script_is_normalised(spark, given, want):
    assert one(spark, X.normalize_script(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("ءامنوا", "منو"), ("الليل", "ليل"), ("الله", "لله"), ("رؤوف", "روف"), ("رحمة", "رحمه"), ("يَٰٓأيها", "ي يه")],
)
def test_deep_keys_fold_spellings(spark, given, want):
    assert one(spark, X.deep_key(F.col("t")), t=given) == want


def test_spelling_key_keeps_written_alefs(spark):
    assert one(spark, X.spelling_key(F.col("t")), t="اذهبا") == "اذهبا"
    assert one(spark, X.spelling_key(F.col("t")), t="ذَٰلِكَ") == "ذلك"


def test_markup_goes_line_by_line(spark):
    assert one(spark, X.strip_markup(F.col("t")), t="﴿a﴾ ** b\n  ۞ c  d ") == "a b\nc d"


def test_ngrams_of_short_and_empty_rows(spark):
    assert one(spark, X.ngrams(X.words(F.col("t")), 3), t="a b c d") == ["a b c", "b c d"]
    assert one(spark, X.ngrams(X.words(F.col("t")), 3), t="a b") == ["a b"]
    assert one(spark, X.ngrams(X.words(F.col("t")), 3), t=" ") == []


def test_run_index_and_counts(spark):
    assert one(spark, X.run_index(F.col("a"), F.col("b")), a=["x", "y", "z", "y"], b=["z", "y"]) == 2
    assert one(spark, X.run_index(F.col("a"), F.col("b")), a=["x"], b=["q"]) == -1
    assert one(spark, X.count_of(F.col("a"), F.col("b")), a="aaaa", b="aa") == 2


def test_chains_break_at_gaps_shifts_and_backward_steps(spark):
    hits = [(1, 1, p, p) for p in range(6)] + [(1, 1, p, p) for p in range(20, 26)] + [(2, 1, 0, 9), (2, 1, 1, 3)]
    got = spans.chain_hits(spark.createDataFrame(hits, "doc long, item long, p long, q long"), ["doc", "item"]).orderBy("w_start").collect()
    assert [(r["w_start"], r["w_end"], r["matched"], r["hits"]) for r in got] == [(0, 9, 9, 6), (20, 29, 9, 6)]


def test_merge_and_gaps_cover_a_document(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 4, 9), (1, 11, 12)], "doc long, w_start long, w_end long")
    merged = spans.merge_spans(df, ["doc"])
    assert sorted((r["w_start"], r["w_end"]) for r in merged.collect()) == [(2, 9), (11, 12)]
    gaps = spans.uncovered(merged, spark.createDataFrame([(1, 15)], "doc long, n_words long"), "doc")
    assert sorted((r["gap_start"], r["gap_end"]) for r in gaps.collect()) == [(0, 2), (9, 11), (12, 15)]


def test_selection_takes_the_best_first(spark):
    df = spark.createDataFrame([(1, 0, 10, 5), (1, 8, 20, 9), (1, 20, 25, 1)], "doc long, w_start long, w_end long, m long")
    got = spans.select_non_overlapping(df, ["doc"], [-F.col("m")]).collect()
    assert sorted((r["w_start"], r["w_end"]) for r in got) == [(8, 20), (20, 25)]


def test_contained_texts_go_once(spark):
    df = spark.createDataFrame([(1, "a b c d", 0), (2, "b c d", 0), (3, "a b c d", 0), (4, "x y z", 0)], "id long, t string, rank int")
    assert sorted(r["id"] for r in refs.drop_contained(df, "id", "t", "rank").collect()) == [1, 4]


def test_chunks_cover_every_word_once(spark):
    text = "One two three four five six seven eight nine ten eleven. " * 9
    got = chunks.chunk_prose(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").orderBy("chunk_idx").collect()
    assert [r["w_start"] for r in got[1:]] == [r["w_end"] for r in got[:-1]]
    assert got[-1]["w_end"] == len(text.split()) and " ".join(r["text"] for r in got) == text.strip()


def test_upsert_keeps_what_is_asked_and_the_old_slug(spark):
    schema = "id long, slug string, note string, old_slugs array<string>"
    t = spark.createDataFrame([(1, "a", "n", []), (2, "b", "m", [])], schema)
    s = spark.createDataFrame([(1, "a2", None, []), (3, "c", "k", [])], schema)
    got = {r["id"]: (r["slug"], r["note"], r["old_slugs"]) for r in catalog.upsert(t, s, "id", ["note"], "slug").collect()}
    assert got == {1: ("a2", "n", ["a"]), 2: ("b", "m", []), 3: ("c", "k", [])}


def test_agents(spark):
    ua = [("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Instagram 300",), ("Googlebot/2.1",), ("Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120",), (None,)]
    got = audience.classify_agent(spark.createDataFrame(ua, "ua string"), "ua").collect()
    assert [(r["bot"], r["os"], r["device"], r["browser"]) for r in got] == [(False, "iOS", "Phone", "Instagram app"), (True, "Other", "Computer", "Other"), (False, "Windows", "Computer", "Edge"), (False, "Other", "Computer", "Other")]


def test_views_and_engagement_are_cleaned(spark):
    v = audience.clean_views(spark.createDataFrame([("home", "A b!", "0123456789"), ("x", None, "short")], "page string, src string, dev string")).collect()
    assert [(r["page"], r["src"], r["dev"]) for r in v] == [("home", "ab", "0123456789"), (None, None, None)]
    e = audience.clean_engagement(spark.createDataFrame([(99999.6, [3, 1, 3, 400, -1])], "open_s double, heard array<int>"), ["open_s"]).first()
    assert (e["open_s"], e["heard"]) == (21600, [1, 3])


def test_interpolation_at_the_ends(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (1, 3, None), (1, 4, 4.0), (1, 5, None)], "k long, o long, v double")
    assert [r["t"] for r in timing.interpolate(df, "k", "o", "v", "t").orderBy("o").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]


def test_quote_swaps_once_only(spark):
    assert one(spark, audit.quote_swap(F.col("t"), F.col("a"), F.col("b")), t="say hello. yes", a="hello.", b="good day") == "say good day. yes"
    assert one(spark, audit.quote_swap(F.col("t"), F.col("a"), F.col("b")), t="hi hi", a="hi", b="ho") == "hi hi"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"a": 1}\nnot json\n{"a": 2, "b": "x"}\n')
    df = tables.json_lines(spark, str(tmp_path / "log"), "a long, b string")
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, None), (2, "x")]
    tables.append_json_lines(df, str(tmp_path / "out"))
    tables.append_json_lines(df, str(tmp_path / "out"))
    assert tables.json_lines(spark, str(tmp_path / "out"), "a long").count() == 4
    (tmp_path / "canon.json").write_text('[{"id": 1, "name": "n", "transliteration": "t", "verses": [{"id": 1, "text": "x"}, {"id": 2, "text": "y"}]}]')
    assert [(r["group_id"], r["passage_id"]) for r in tables.nested_canon(spark, str(tmp_path / "canon.json")).collect()] == [(1, 1), (1, 2)]
    empty = spark.createDataFrame([], "a long")
    assert tables.when_empty(empty, spark.createDataFrame([(7,)], "a long")).count() == 1
    assert tables.when_empty(spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([(7,)], "a long")).first()["a"] == 1


def test_throttle_equals_a_plain_loop(spark):
    from quotary.plans.streams import stream_throttle

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().sort_values(["ts", "event_id"])
    want, last = {}, {}
    for r in rows.itertuples():
        us = r.ts.value // 1000
        ok = r.event_type == "purchase" or r.user_id not in last or us - last[r.user_id] >= 21600 * 10**6
        if ok and r.event_type != "purchase":
            last[r.user_id] = us
        if ok:
            want[r.user_id] = want.get(r.user_id, 0) + 1
    assert {r["user_id"]: r["passed"] for r in stream_throttle(spark, "/root/testdata/sf0.001").collect()} == want
