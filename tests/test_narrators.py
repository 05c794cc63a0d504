"""Narrator lines, places on chains and the name that is shown, on lines of our own."""

import pytest
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import narrators as R

LINES = [
    ("Narrated Jabir:", "", None, "Jabir", "own"),
    ("Narrated Jabir:", "", "Muadh ibn Jabal", "Jabir", "own"),
    ("Zayd b. Thabit reported the Prophet (ﷺ) as saying:", "", None, "Zayd b. Thabit", "own"),
    ("It has been narrated on the authority of Jundub that", "Whoever is heard", None, "Jundub", "own"),
    ("On the authority of Tamim, who said:", "", None, "Tamim", "own"),
    ("Qatadah narrated from Hudhayfah that the Messenger of Allah said:", "", None, "Hudhayfah", "companion"),
    ("Qatadah narrated from Hudhayfah that the Messenger of Allah said:", "", "Hudhaifa ibn al-Yaman", "Hudhaifa ibn al-Yaman", "confirmed"),
    ("Bahz bin Hakim narrated from his father, from his grandfather, that he was told", "", None, "Bahz bin Hakim from his father, from his grandfather", "line"),
    ("Bahz bin Hakim narrated from his father, from his grandfather, that he was told", "", "Bahz", "Bahz", "confirmed"),
    ("Yazid bin Aslam narrated from his father -he had been there-", "", None, "Aslam", "own"),
    ("Narrated Alqamah:", "<p>“I heard Uthman bin Madh'un saying in the market</p>", None, "Uthman bin Madh'un", "companion"),
    ("Narrated Alqamah:", "I heard the Messenger of Allah saying", None, "Alqamah", "own"),
    ("Narrated Tawus:", "The Companions of the Prophet (ﷺ) informed us that it rained", "Tawus ibn Kaysan", "Companions of the Prophet ﷺ", "companion"),
    ("Masruq reported:", "I asked Umm Salama, who was old, about it", None, "Umm Salama", "companion"),
    ("Masruq reported:", "I asked the Prophet (ﷺ) about it", None, "Masruq", "own"),
    ("Narrated Ikrimah:", "We were sitting with Burayda when the sun set", None, "Burayda", "companion"),
    ("Narrated Hudhayfah:", "We were with the Prophet (ﷺ) at noon", None, "Hudhayfah", "own"),
    ("Yahya narrated to us, he said, Malik narrated to us, on authority of Nafi, on authority of Abī Barza, he said, the Messenger of Allah said", "", None, "Abu Barza", "companion"),
    ("Khalid b. al-Walid reported:", "", "Sulayman bin Khalid bin al-Walid", "Sulayman bin Khalid bin al-Walid", "fuller"),
    (None, "I heard Burayda saying", "Burayda", None, "no name"),
    ("  ", None, None, None, "no name"),
]
CHAINS = [
    ("حدثنا سفيان عن طارق عن برزة قال رسول الله صلى الله عليه وسلم", "Narrated Tariq:", "Barza", "Barza", "nearer"),
    ("حدثنا سفيان عن برزة عن طارق قال رسول الله صلى الله عليه وسلم", "Narrated Tariq:", "Barza", "Tariq", "own"),
    ("حدثنا سفيان عن طارق عن برزة", "Narrated Tariq:", "Barza", "Tariq", "own"),
    ("حدثنا سفيان عن طارق قال رسول الله لبرزة", "Narrated Tariq:", "Barza", "Tariq", "own"),
    ("حدثنا طارق عن برزة عن جندب قال النبي", "Tariq narrated from Barza that he said", "Jundub", "Jundub", "nearer"),
]


def test_lines_and_chains(spark):
    rows = [(i, *r[:3], None, *r[3:]) for i, r in enumerate(LINES)] + [(100 + i, line, "", claimed, chain, want, why) for i, (chain, line, claimed, want, why) in enumerate(CHAINS)]
    cards = spark.createDataFrame(rows, "id int, line string, lead string, claimed string, chain string, want string, why string")
    cards = cards.withColumn("page", R.read_line(F.col("line"), F.col("lead"))).withColumn("chain", X.deep_key(F.col("chain")))
    got = cards.join(R.shown_narrators(cards, "id"), "id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["shown"], r["reason"]) == (r["want"], r["why"]), r


def test_rules_are_read_in_order(spark):
    rules = [R.Rule("line", "^(\\w+) and (\\w+)", 2, 1), R.Rule("line", "^(\\w+)", 1, "all")]
    page = spark.createDataFrame([("Ann and Bo",), ("Cy",), ("?",)], "t string").select(R.read_line(F.col("t"), F.lit(None).cast("string"), rules).alias("p")).collect()
    assert [tuple(r["p"]) for r in page] == [("Bo", "Ann", True), ("Cy", "all", True), ("?", "?", False)]


@pytest.mark.parametrize("end", [r"^stop$", None])
def test_places_on_a_chain(spark, end):
    chains = spark.createDataFrame([(1, "karim salim karim stop basim"), (2, "karim"), (3, None)], "k int, c string")
    names = spark.createDataFrame([(1, "a", "Kareem"), (1, "b", "Basim"), (1, "c", "nobody"), (2, "a", "karim"), (3, "a", "karim")], "k int, who string, n string")
    got = R.chain_places(chains, names, ["k"], "c", "who", "n", sound=lambda w: F.regexp_replace(w, "[aeiou]", ""), end=end).collect()
    assert {(r["k"], r["who"], r["place"]) for r in got} == ({(1, "a", 2)} if end else {(1, "a", 2), (1, "b", 4), (2, "a", 0)})
