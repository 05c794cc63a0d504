"""Term rules, containment, the chain of filters, windows and sketches on small rows, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quotary.operators import audience, refs, terms
from quotary.operators import timing as T

RULES = "lang string, term string, kind string, instead string"


def test_terms_by_language(spark):
    rules = spark.createDataFrame([("en", "Cat", "word", "dog"), ("en", "cat", "word", "dog"), ("en", "two  words", "word", None), (None, "ab", "part", None), ("de", "é", "word", None), ("en", None, "word", None), ("en", "", "part", None)], RULES)
    texts = spark.createDataFrame([(1, "en", "A CAT, concat cat_ cat. two  words"), (2, "de", "é cat abab"), (3, "xx", "cat crab"), (4, None, "cab"), (5, "en", None), (6, "en", ""), (7, "en", "x" * 100_000 + " cat")], "id int, lang string, t string")
    got = {(r["id"], r["term"]): (r["instead"], r["n"], r["first"]) for r in terms.term_findings(texts, ["id"], "lang", "t", rules).collect()}
    assert got == {(1, "cat"): ("dog", 2, 2), (1, "two  words"): (None, 1, 24), (2, "é"): (None, 1, 0), (2, "ab"): (None, 2, 6), (3, "ab"): (None, 1, 6), (4, "ab"): (None, 1, 1), (7, "cat"): ("dog", 1, 100_001)}


def test_language_pack_rules(spark):
    texts = spark.createDataFrame([(1, "bn", "সে স্বর্গ আর তায়ালা বলিয়াছে ok"), (2, "en", "plain żółw")], "id int, lang string, t string")
    got = {(r["id"], r["term"], r["instead"]) for r in terms.term_findings(texts, ["id"], "lang", "t", terms.rules_of(spark)).collect()}
    assert got == {(1, "স্বর্গ", None), (1, "তায়ালা".replace("য়", "য়"), "তাআলা"), (1, "িয়াছ".replace("য়", "য়"), None)}
    assert {(r["id"], r["outside"]) for r in terms.script_findings(texts, ["id"], "lang", "t").collect()} == {(1, 2), (2, 0)}


@pytest.mark.parametrize("seed", [1, 2, 3, 12])
def test_containment_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for _ in range(90)] + ["x", "word", "a word", "swordfish is a word here", "swordfish is a word", None, "", "only here and nowhere else"]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id int, t string, rank int")
    first = {}
    for i, t, _ in rows:
        if t:
            first.setdefault(t, i)
    want = {(i, j) for t, i in first.items() for u, j in first.items() if t != u and t in u}
    assert {(r["id"], r["held_by"]) for r in refs.contained(frame, "id", "t", seed).collect()} == want
    best = {}
    for i, t, r in rows:
        if t:
            best[t] = min(best.get(t, (r, i)), (r, i))
    kept = {i for t, (_, i) in best.items() if not any(t != u and t in u for u in best)} | {i for i, t, _ in rows if not t}
    assert {r["id"] for r in refs.drop_contained(frame, "id", "t", "rank").collect()} == kept


def test_chain_of_filters(spark):
    formulas = spark.createDataFrame([(1, "peace be on all of you")], "f int, ft string")
    rows = [(1, 0, "the first saying of four words", "n"), (1, 1, "saying of four words", "n"), (1, 2, "what the first saying of four words is", "n"), (1, 3, "peace be on you all of", "n"), (1, 4, "another saying altogether here", "old"), (1, 5, "too short", "n"), (1, 6, "short one!", "n"), (1, 7, None, "n"), (2, 0, "saying of four words", "n")]
    frame = spark.createDataFrame(rows, "d int, o int, t string, m string")
    got = refs.deduplicated(frame, "d", "o", "t", method="m", retired="old", formulas=formulas, passage="f", formula="ft", content=F.col("t"), aloud=F.col("t").endswith("!"))
    assert {(r["d"], r["o"]) for r in got.collect()} == {(1, 0), (1, 6), (2, 0)} and got.columns == frame.columns


def test_windows_cover_a_series_once(spark):
    totals = spark.createDataFrame([("a", 100.0), ("b", 5.0), ("c", 24.0), ("d", 30.5)], "k string, total double")
    w = T.overlapping_windows(totals, "k", "total", 30.0, 6.0)
    assert {k: [(r["start"], r["lo"], r["hi"]) for r in w.where(F.col("k") == k).orderBy("window").collect()] for k in "bcd"} == {"b": [(0, float("-inf"), float("inf"))], "c": [(0, float("-inf"), float("inf"))], "d": [(0, float("-inf"), 27), (24, 27, float("inf"))]}
    words = spark.createDataFrame([("a", i, i / 3) for i in range(300)], "k string, i int, at double")
    spans = w.select("k", "window", "start", (F.col("start") + 30).alias("end"))
    heard = T.in_ranges(words, spans, "k", "at", "start", "end", 10.0).select("k", "i", "window", (F.col("at") - F.col("start")).alias("at"))
    got = T.stitched(heard, w, "k").orderBy("i").collect()
    assert heard.count() > 300 and [r["i"] for r in got] == list(range(300)) and all(abs(r["at"] - r["i"] / 3) < 1e-9 for r in got)


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_ranges_hold_what_comparing_all_finds(spark, width):
    rng = random.Random(7)
    points = [(rng.randint(1, 3), i, rng.uniform(-20, 20)) for i in range(200)]
    ranges = [(rng.randint(1, 4), i, a, a + rng.choice([0.0, 0.1, 5.0, 30.0])) for i, a in enumerate(rng.uniform(-25, 25) for _ in range(60))] + [(1, 100, float("-inf"), 0.0), (2, 101, 0.0, float("inf")), (1, 102, 5.0, 1.0)]
    got = T.in_ranges(spark.createDataFrame(points, "k int, p int, at double"), spark.createDataFrame(ranges, "k int, r int, lo double, hi double"), "k", "at", "lo", "hi", width).collect()
    assert sorted((x["p"], x["r"]) for x in got) == sorted((p, r) for k, p, at in points for j, r, lo, hi in ranges if j == k and lo <= at < hi)


def test_first_segment_that_ends_later(spark):
    rows, seg = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (2, 1)], "k int, at int"), spark.createDataFrame([(1, 5, 7), (1, 5, 3), (1, 8, 4)], "k int, e int, s int")
    got = T.first_ending_after(rows, seg, "k", "at", "e", "s", "seg").collect()
    assert {(r["k"], r["at"], r["seg"]) for r in got} == {(1, 0, 3), (1, 5, 4), (1, 9, None), (2, 1, None)}


def test_sketches_merge_over_days(spark):
    rows = spark.createDataFrame([(d, (u * 7 + d) % 900) for d in range(10) for u in range(500)] + [(3, None)], "d int, u int").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    sketches = audience.daily_sketches(rows, F.col("day"), F.col("u"))
    assert {r["n"] for r in sketches.collect()} == {500}
    exact = {d: len({(u * 7 + e) % 900 for e in range(max(0, d - 2), d + 1) for u in range(500)}) for d in range(10)}
    got = audience.distinct_over(sketches, 3).orderBy("day").collect()
    assert len(got) == 10 and all(abs(r["ids"] - exact[d]) <= 0.05 * exact[d] for d, r in enumerate(got))


def test_transcripts_and_swaps(spark):
    from quotary.operators import audit

    rows = [("all plain words here", None, None), ("half ضصثق", None, "50% of its letters"), ("one two three", "a b c d", "3 words against 4"), ("one two three four", "a b c d e", None), ("12 34", None, "0% of its letters"), (None, None, "0% of its letters")]
    got = spark.createDataFrame(rows, "t string, s string, want string").withColumn("got", audit.transcript_problem(F.col("t"), F.col("s"))).collect()
    assert all(r["got"] == r["want"] for r in got), got
    swaps = [
        ("he said go home now", "go home now", "please go home", "ok"), ("go on and go on", "go on", "move on", "not once"), ("x", "go", "go", "not once"), ("go home", "go home", "go home", "same"), ("go home", "go home", "go " * 9, "length"),
        ("he gave two coins", "he gave two coins", "he gave some coins", "drops"), ("we went to our home", "we went to our home", "and I went to my home", "person"), ("they saw a man there", "they saw a man there", "they saw Khalid there too", "adds"),
    ]
    got = spark.createDataFrame(swaps, "t string, a string, b string, want string").withColumn("got", audit.judged_swap(F.col("t"), F.col("a"), F.col("b"))).collect()
    assert all(r["got"] == r["want"] for r in got), got


def test_a_walk_through_a_group_of_thousands(spark):
    """One gram stands in every passage; a walk meets one passage a round, not the group."""
    from quotary.operators import quotes

    canon = spark.createDataFrame([(1, i, ["so", "they", "all", "said", f"w{i}"]) for i in range(5000)], "group long, passage long, words array<string>")
    said = [w for i in (10, 11, 12) for w in ["so", "they", "all", "said", f"w{i}"]] + ["end"] * 5
    rows = spark.createDataFrame([("d", said)], "doc string, deep array<string>")
    spans = spark.createDataFrame([("d", 0, 5, [(1, 10, 0, 5)])], "doc string, start long, end long, parts " + f"array<{quotes.PART}>")
    r = quotes.walk_on(spans, rows, canon, "doc").first()
    assert (r["start"], r["end"], [p["passage"] for p in r["parts"]]) == (0, 15, [10, 11, 12])
