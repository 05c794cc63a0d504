"""Names and rules on shown texts, on rows with known answers."""

import pytest
from pyspark.sql import functions as F

from quotary.functions import cards as C
from quotary.functions import lang as L
from quotary.functions import names as N
from quotary.functions import text as X


def test_numbers_and_slugs(spark):
    df = spark.createDataFrame([("ara-muslim", "4938", "1913.01", "1913a"), ("ara-muslim", "1", None, None), ("ara-muslim", "5", "7", "7"), ("ara-nasai", "12", "13", "12"), ("ara-nasai", None, "13", "13")], "c string, n string, o string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", N.shown_number(F.col("c"), F.col("n"), F.col("o"))).collect())
    slugs = spark.createDataFrame([("Sahih al-Bukhari", "bukhari"), ("Sunan Abi Dawud", "abudawud"), ("Sunan Ibn Maja", "ibnmajah"), ("Other", None), (None, None)], "n string, want string")
    assert all(r["got"] == r["want"] for r in slugs.withColumn("got", N.collection_slug(F.col("n"))).collect())
    shown = slugs.select(N.slug_display(F.lit("nasai")).alias("a"), N.slug_display(F.lit("own")).alias("b"), N.collection_rank(F.lit("muslim")).alias("r")).first()
    assert (shown["a"], shown["b"], shown["r"]) == ("Sunan an-Nasa'i", "own", 2)


def test_bodies(spark):
    rows = [("حدثنا فلان قال رسول الله صلى الله عليه وسلم انما الاعمال بالنيات", "انما الاعمال بالنيات"), ("عن ابي هريره ان النبي صلى الله عليه وسلم قال من صام رمضان ايمانا", "من صام رمضان ايمانا"), ("كلمه بلا سند", "كلمه بلا سند"), ("حدثنا احمد عن يحيى عن سعيد قال كنا نصلي", "كنا نصلي")]
    for r in spark.createDataFrame(rows, "t string, want string").withColumn("got", N.body(F.col("t"))).collect():
        assert r["got"] == r["want"]


def test_script_predicates(spark):
    words = "وهذا قول يقول النبي صلى الله عليه وسلم ليس الغنى".split()
    df = spark.createDataFrame([(words, i) for i in range(len(words))], "w array<string>, at int")
    light = df.withColumn("light", F.transform("w", L.ARABIC.light))
    assert [r["at"] for r in light.where(L.splits_phrase(F.col("light"), F.col("at"))).collect()] == [5, 6, 7]
    pleas = [("يا قوي. اللهم جنبنا الفتن ما ظهر", 4, True), ("اللهم اغفر لنا. ما ظهر منها", 4, False), ("اللهم إنا ندعوك قال سبحانه ادعوني أستجب", 5, False), ("كلام", 0, False)]
    for r in spark.createDataFrame(pleas, "t string, at int, want boolean").withColumn("got", L.in_plea_sentence(X.words(F.col("t")), F.col("at"))).collect():
        assert r["got"] == r["want"], r
    one = spark.createDataFrame([("والكتاب", "لن", "وقال")], "c string, n string, s string").select(L.strip_clitic(F.col("c")).alias("c"), L.is_negation(F.col("n")).alias("n"), L.cites(F.col("s")).alias("s"), L.is_negation(F.col("s")).alias("x")).first()
    assert (one["c"], one["n"], one["s"], one["x"]) == ("كتاب", True, True, False)


def test_unicode_forms(spark):
    df = spark.createDataFrame([("Masjid al-Ḥarām (Makkah)", "al-haram-makkah"), ("جامع", ""), (None, None)], "n string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", L.place_slug(F.col("n"))).collect())
    assert spark.createDataFrame([("كتابةٌ علي",)], "t string").select(L.loose_words(F.col("t")).alias("w")).first()["w"] == ["کتابہ", "علی"]


@pytest.mark.parametrize(("ours", "published", "added", "dropped", "shift"), [
    ("He said that Umar gave two camels to us", "Umar gave camels and I saw Khalid there", ["Khalid"], ["two"], ["I"]),
    ("they went to Makkah with 40 men", "they went to Mecca with 40 men", [], ["Makkah"], []),
    ("no names here", "none here either", [], [], []),
])
def test_wordings(spark, ours, published, added, dropped, shift):
    r = spark.createDataFrame([(ours, published)], "a string, b string").select(C.added_names(F.col("b"), F.col("a")).alias("added"), C.dropped_words(F.col("a"), F.col("b")).alias("dropped"), C.person_shift(F.col("a"), F.col("b")).alias("shift")).first()
    assert (r["added"], sorted(r["dropped"]), r["shift"]) == (added, sorted(dropped), shift)


def test_neighbours(spark):
    rows = [
        ("one two three four five six seven", "one two", "seven six five four three", "x", True, False),
        ("one two three", "one two", "three", "x", False, False),
        ("start of it", "last words start of it", "these last words", "", False, True),
        ("start of it", "start of it", "start of it", "start of it", False, False),
    ]
    df = spark.createDataFrame(rows, "b string, a string, p string, n string, removes boolean, repeats boolean")
    for r in df.withColumns({"x": C.removes_neighbour(F.col("b"), F.col("a"), F.array("p", "n")), "y": C.repeats_neighbour(F.col("b"), F.col("a"), F.col("p"), F.col("n"))}).collect():
        assert (r["x"], r["y"]) == (r["removes"], r["repeats"]), r


def test_pairs_excerpts_takes(spark):
    pairs = [([[0, 1], [2, 3]], 3, 4, True), ([[0, 1], [0, 3]], 1, 4, False), ([[2, 3]], 3, 4, True), ([[2, 3]], 4, 4, False), ([], 1, 1, False), (None, 1, 1, False), ([[1], [2, 3]], 3, 4, False)]
    for r in spark.createDataFrame(pairs, "p array<array<int>>, a int, b int, want boolean").withColumn("got", C.valid_pairs(F.col("p"), F.col("a"), F.col("b"))).collect():
        assert r["got"] == r["want"], r
    e = spark.createDataFrame([("“b c”", "a b c d", 0.25, 0.75, "b c"), ("x", "a b", 0.0, 1.0, None), ("a", "a b c d", 0.9, 1.0, None)], "x string, f string, s double, e double, want string")
    assert all(r["got"] == r["want"] for r in e.withColumn("got", C.accepted_excerpt(F.col("x"), F.col("f"), F.col("s"), F.col("e"))).collect())
    t = spark.createDataFrame([(1, 40, 0.5, 1.0, None, True), (3, 40, 0.5, 1.0, None, False), (1, 40, 0.9, 1.2, None, False), (2, 40, 0.5, 1.0, 0.5, False), (1, 39, 0.1, 1.0, None, False), (1, 40, None, None, None, False)], "t int, n int, s double, e double, b double, want boolean")
    assert all(r["got"] == r["want"] for r in t.withColumn("got", C.take_again(F.col("t"), F.col("n"), F.col("s"), F.col("e"), F.col("b"))).collect())
    s = spark.createDataFrame([("Text.\n\n📖 Source 1:2\n\n❝ Quoted", 7)], "t string, n int").select(C.shown_text(F.col("t")).alias("s"), C.edition_text(F.lit("heading ৭. " + "ৰ" * 60 + " [1] note"), F.col("n")).alias("e")).first()
    assert s["s"] == "Text. Quoted" and s["e"] == "র" * 60
