"""What comes in from outside, and claims against matches, on odd rows."""

from pyspark.sql import functions as F

from quotary.operators import chunks, intake, refs

ENGAGE = "id string, open_s double, played_s double, max_pos double, dur double, depth double, copies double, refs double, lang string, voices map<string,double>, durs map<string,double>, heard map<string,array<double>>"


def test_engagement_keeps_its_limits(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("0123456789ab", -1.0, 2.5, 1e9, 0.4, 250.0, 49.5, 501.0, "ur", {"imam": 3.49, "xx": 1.0, "en": None}, {"bn": nan}, {"imam": [3.0, 1.0, 3.0, 1.5, 360.0, -1.0, None, 359.0], "en": None}), ("0123456789ab", nan, inf, None, None, None, None, None, None, None, None, None), ("0123456789AB", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "en", {}, {}, {}), (None, *[None] * 11)]
    a, b = sorted(intake.engagement(spark.createDataFrame(rows, ENGAGE)).collect(), key=lambda r: -r["played_s"])
    assert tuple(a) == ("0123456789ab", 0, 3, 21600, None, 100, 50, 500, "ur", {"imam": 3}, {"bn": 0}, {"imam": [1, 3, 359]})
    assert tuple(b) == ("0123456789ab", 0, 0, 0, None, 0, 0, 0, "en", None, None, None)


def test_feedback_and_comments(spark):
    shape = "ts long, message string, name string, contact string, page string, agent string, public boolean, website string"
    rows = [(1, " \n", "a", None, None, None, True, None), (2, None, "a", None, None, None, True, None), (3, " hi \t", " Ann ", "a@b", "", "ua", True, ""), (4, "bot", "b", None, None, None, True, "x"), (5, "z" * 3000, "n" * 99, None, "p", None, None, None), (6, "later", None, None, None, None, True, None), (7, "gone", None, None, None, None, True, None)]
    kept = intake.feedback(spark.createDataFrame(rows, shape))
    got = {r["ts"]: r for r in kept.collect()}
    assert set(got) == {3, 5, 6, 7} and "website" not in kept.columns
    assert (got[3]["message"], got[3]["name"], got[3]["page"], got[3]["public"]) == ("hi", "Ann", None, True)
    assert (len(got[5]["message"]), len(got[5]["name"]), got[5]["public"]) == (2000, 60, False)
    shown = intake.comments(kept, spark.createDataFrame([(7,), (7,), (None,)], "ts long"), newest=5)
    assert [(r["ts"], r["message"]) for r in shown.collect()] == [(6, "later"), (3, "hi")] and shown.columns == ["ts", "name", "message"]


def test_entries_say_why_they_are_rejected(spark):
    shape = "folder string, slug string, title string, media_url string, note string, old_slugs array<string>, featured boolean"
    rows = [("a-1", "a-1", "T", None, "n" * 3000, ["x", None], True), ("../a", "a", "T", None, "", None, None), ("a", "A", "T", None, None, None, None), ("a", "a", "", None, None, None, None), ("a", "a", "T", "http://x/", None, None, None), ("a", "a", "T", "https://x/y/", None, ["s"] * 60, None), (None, None, None, None, None, None, None), (".a", "a" * 81, "T", "https://x", None, None, None)]
    got = intake.entries(spark.createDataFrame(rows, shape)).collect()
    assert [r["reject"] for r in got] == [None, "folder", "slug", "title", "media_url", None, "folder", "folder"]
    assert len(got[0]["note"]) == 2000 and got[0]["old_slugs"] == ["x"] and got[0]["featured"] and got[1]["note"] is None and got[1]["featured"] is False and len(got[5]["old_slugs"]) == 50


def test_the_words_settle_a_difference(spark):
    canon = spark.createDataFrame([(1, 1, "kind words heal old wounds".split()), (1, 2, "kind words cost nothing yet they give much to all".split()), (2, 1, "rivers run to the sea".split())], "group long, passage long, words array<string>")
    rows = [
        (0, "kind words heal old", (1, 1), (1, 1), 0.7), (1, "kind words heal nothing much to all", (1, 2), (1, 1), 0.9), (2, "kind words cost heal old wounds", (1, 2), (1, 1), 0.9), (3, "rivers run to the sea", (1, 2), (2, 1), 0.99),
        (4, "rivers words kind heal", (1, 1), (2, 1), 0.6), (5, "x", (9, 9), None, None), (6, "rivers", None, (2, 1), 0.444), (7, "x", None, None, None), (8, "", (1, 1), (2, 1), 0.5), (9, "rivers run to the sea", (9, 9), (2, 1), 1.0),
    ]
    place = "struct<group:bigint,passage:bigint>"
    frame = spark.createDataFrame([(i, t.split(), c, m, s) for i, t, c, m, s in rows], f"k int, said array<string>, claimed {place}, matched {place}, score double")
    got = {r["k"]: (r["group"], r["passage"], r["confidence"], r["verdict"], r["used"]) for r in refs.settled_claims(frame, canon, ["k"], "said", "score").collect()}
    assert got == {
        0: (1, 1, 0.95, "agree", "claim"), 1: (1, 1, 0.75, "differ", "match"), 2: (1, 2, 0.75, "differ", "claim"), 3: (2, 1, 0.75, "differ", "match"), 4: (1, 1, 0.75, "differ", "claim"),
        5: (9, 9, 0.85, "claim only", "claim"), 6: (2, 1, 0.44, "match only", "match"), 7: (None, None, 0.0, "no match", "none"), 8: (1, 1, 0.75, "differ", "claim"), 9: (2, 1, 0.75, "differ", "match"),
    }


def test_rows_that_break_off(spark):
    rows = [(1, 0, "First. and then the old man said..."), (1, 1, "and then the old man said to all"), (1, 2, "nothing…"), (1, 3, "else"), (1, 4, "the end..."), (2, 0, None)]
    got = chunks.broken_off(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t").collect()
    assert [tuple(r) for r in got] == [(1, 0, 5)]


def test_repeats_are_those_of_a_plain_search():
    import random

    rng = random.Random(5)
    for _ in range(300):
        w = [rng.choice(["a", "b", "c", ""]) for _ in range(rng.randint(0, 60))]
        n, within, want, at = rng.choice([2, 3, 5]), rng.choice([0, 4, 30]), [], 0
        for i in range(len(w)):
            j = next((j for j in range(i + n, min(i + n + within, len(w) - n) + 1) if w[i : i + n] == w[j : j + n] and "" not in w[i : i + n]), None)
            if j is not None and i >= at:
                m = n
                while i + m < j and j + m < len(w) and w[i + m] == w[j + m] != "":
                    m += 1
                want.append({"i": i, "j": j, "n": m})
                at = i + m
        assert chunks.repeated_runs(w, n, within) == want
