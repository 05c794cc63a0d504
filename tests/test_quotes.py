"""The quotation finder on a small canon in the script, and its alignment against a plain dynamic programme."""

import random

import pytest
from pyspark.sql import functions as F

from quotary.functions.lang import ARABIC
from quotary.operators import quotes

CANON = [
    (2, 197, "الحج أشهر معلومات فمن فرض فيهن الحج فلا رفث ولا فسوق ولا جدال في الحج وما تفعلوا من خير يعلمه الله"),
    (2, 201, "ومنهم من يقول ربنا آتنا في الدنيا حسنة وفي الآخرة حسنة وقنا عذاب النار"),
    (6, 151, "قل تعالوا أتل ما حرم ربكم عليكم ألا تشركوا به شيئا ولا تقربوا الفواحش ما ظهر منها وما بطن ولا تقتلوا النفس"),
    (7, 17, "ثم لآتينهم من بين أيديهم ومن خلفهم وعن أيمانهم وعن شمائلهم ولا تجد أكثرهم شاكرين"),
    (7, 33, "قل إنما حرم ربي الفواحش ما ظهر منها وما بطن والإثم والبغي بغير الحق"),
    (9, 51, "قل لن يصيبنا إلا ما كتب الله لنا هو مولانا وعلى الله فليتوكل المؤمنون"),
    (16, 98, "فإذا قرأت القرآن فاستعذ بالله من الشيطان الرجيم"),
    (17, 21, "انظر كيف فضلنا بعضهم على بعض وللآخرة أكبر درجات وأكبر تفضيلا"),
    (20, 24, "اذهب إلى فرعون إنه طغى"),
    (20, 25, "قال رب اشرح لي صدري"),
    (20, 26, "ويسر لي أمري"),
    (20, 43, "اذهبا إلى فرعون إنه طغى"),
    (20, 44, "فقولا له قولا لينا لعله يتذكر أو يخشى"),
    (49, 13, "يا أيها الناس إنا خلقناكم من ذكر وأنثى وجعلناكم شعوبا وقبائل لتعارفوا إن أكرمكم عند الله أتقاكم إن الله عليم خبير"),
    (65, 2, "ذلكم يوعظ به من كان يؤمن بالله واليوم الآخر ومن يتق الله يجعل له مخرجا"),
    (65, 3, "ويرزقه من حيث لا يحتسب ومن يتوكل على الله فهو حسبه إن الله بالغ أمره قد جعل الله لكل شيء قدرا"),
    (79, 17, "اذهب إلى فرعون إنه طغى"),
    (79, 18, "فقل هل لك إلى أن تزكى"),
    (79, 19, "وأهديك إلى ربك فتخشى"),
]
TEXTS = {
    "alef": "ثم جاءهما الأمر اذهبا إلى فرعون إنه طغى فقولا له قولا لينا لعله يتذكر أو يخشى",
    "next": "فناداه في الوادي اذهب إلى فرعون إنه طغى قال رب اشرح لي صدري ويسر لي أمري",
    "other": "وفي موضع ثالث اذهب إلى فرعون إنه طغى فقل هل لك إلى أن تزكى وأهديك إلى ربك فتخشى",
    "cited": "يأتيه الفرج والمال الكثير من حيث لا يحتسب، قال تعالى: ومن يتق الله يجعل له مخرجاً ويرزقه من حيث لا يحتسب. فهذا وعد صادق",
    "opener": "تأملوا حال الناس اليوم. أعوذ بالله من الشيطان الرجيم: انظر كيف فضلنا بعضهم على بعض وللآخرة أكبر درجات وأكبر تفضيلاً. نفعنا الله بما سمعنا",
    "denied": "نحن على يقين راسخ، وأنه لا يصيبنا إلا ما كتب الله لنا، وأن كل أمر بقدر",
    "none": "هذه جملة من عندنا ليست من المتن وليس فيها شيء منه",
    "plea": "يا أرحم الراحمين. اللهم جنبنا الفتن ما ظهر منها وما بطن، عن أهلنا جميعا",
    "long plea": "اللهم كن لأهلنا في كل أرض، اللهم احفظهم من بين أيديهم ومن خلفهم وعن أيمانهم وعن شمائلهم ومن تحتهم",
    "brief": "لا يسبق أحد أحدا بنسبه. إن أكرمكم عند الله أتقاكم. فالعمل هو الميزان",
    "own plea": "يا أكرم الأكرمين اللهم آتنا في الدنيا حسنة وفي الآخرة حسنة وقنا عذاب النار",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc string, text string")
    canon = spark.createDataFrame(CANON, "group long, passage long, text string")
    spans = quotes.find_spans(docs, canon, "doc", "text").cache()
    return docs, canon, spans


def shown(spans):
    out = {}
    for r in sorted(spans.collect(), key=lambda r: (r["doc"], r["start"])):
        w = TEXTS[r["doc"]].split()
        out.setdefault(r["doc"], []).append((w[r["start"]], w[r["end"] - 1], ",".join(f"{p['group']}:{p['passage']}" for p in r["parts"])))
    return out


def test_spans_of_the_script(found):
    got = shown(found[2])
    assert got["alef"] == [("اذهبا", "يخشى", "20:43,20:44")]
    assert got["next"] == [("اذهب", "أمري", "20:24,20:25,20:26")]
    assert got["other"] == [("اذهب", "فتخشى", "79:17,79:18,79:19")]
    assert got["cited"][-1] == ("ومن", "يحتسب.", "65:2,65:3")
    assert got["opener"][-1] == ("انظر", "تفضيلاً.", "17:21")
    assert got["denied"] == [("لا", "لنا،", "9:51")]
    assert "none" not in got


def test_borrowed_phrases_go_and_quotations_stay(found):
    docs, canon, spans = found
    kept = {(r["doc"], f"{r['group']}:{r['passage']}") for r in quotes.drop_borrowed(spans.where("end - start >= 5"), docs, canon, "doc", "text").collect()}
    assert ("plea", "6:151") not in kept and ("plea", "7:33") not in kept and ("long plea", "7:17") not in kept
    assert ("brief", "49:13") in kept and ("own plea", "2:201") in kept and ("next", "20:24") in kept


def test_references_from_spans(found, spark):
    runs = quotes.refs_from_spans(found[2], "doc")
    got = {(r["doc"], r["group"], r["first"], r["last"]) for r in runs.collect()}
    assert {("alef", 20, 43, 44), ("next", 20, 24, 26), ("other", 79, 17, 19), ("cited", 65, 2, 3)} <= got
    old = spark.createDataFrame([("next", 20, 25, 3, 5, 0.9, "claim"), ("brief", 4, 1, 0, 3, 0.9, "claim")], "doc string, group long, passage long, start long, end long, confidence double, method string")
    refs = {(r["doc"], r["group"], r["first"], r["last"], r["method"]) for r in quotes.widened_refs(old, runs, "doc").collect()}
    assert {("next", 20, 24, 26, "claim"), ("brief", 4, 1, 1, "claim"), ("alef", 20, 43, 44, "ngram")} <= refs
    assert ("next", 20, 24, 26, "ngram") not in refs


def plain(a, b):
    """Best local score by the definition."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -2), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignments_are_optimal():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices(range(6), k=rng.randint(0, 14)) for _ in range(2))
        first, end, matched = quotes.aligned(a, b)
        if not a or not b or not set(a) & set(b):
            assert (first, end, matched) == (-1, 0, 0) or matched == 0
            continue
        # the stretch found holds an optimal alignment, and begins and ends on matched words
        assert plain(a, b[first:end]) == plain(a, b) and b[first] in a and b[end - 1] in a and 0 < matched <= end - first


def test_misheard_words(spark):
    rows = [("aaaa bbbb cccc dddd".split(), "aaaa bbbb cccc dddd".split(), 0, True), ("aaaa bbbb cccc dddd".split(), "x aaaa bbbc cccc dddd".split(), 1, True),
            ("aaaa bbbb cccc dddd".split(), "aaaa bbxx cccc dddd".split(), 0, True), ("aaaa bbbb cccc dddd".split(), "aaaa bbxx ccxx dddd".split(), 0, False),
            ("aaaa bbbb cccc dddd".split(), "aaaa xxxx cccc dddd".split(), 0, False), ("aaa bbb".split(), "aaa bbb".split(), 1, False), ([], ["a"], 0, False), (["abc"], ["abd"], 0, False)]
    df = spark.createDataFrame(rows, "want array<string>, have array<string>, at long, ok boolean")
    assert all(r["got"] == r["ok"] for r in df.withColumn("got", quotes.tolerant_run(F.col("want"), F.col("have"), F.col("at"))).collect())


def test_odd_documents(spark):
    canon = spark.createDataFrame(CANON, "group long, passage long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "اذهب إلى فرعون إنه طغى")], "doc long, text string")
    assert quotes.find_spans(docs.where("doc is not null"), canon, "doc", "text", ARABIC).count() == 0
    assert quotes.find_spans(docs, canon.limit(0), "doc", "text", ARABIC).count() == 0
