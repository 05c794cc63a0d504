"""Assembled blocks, labels over ranges and windows against plain versions."""

import random

from pyspark.sql import functions as F

from quotary.operators import assembly as A
from quotary.operators import attribution as N
from quotary.operators import quotes
from quotary.plans import assembling

DATA = "/root/testdata/sf0.001"


def test_every_word_is_in_exactly_one_block(spark):
    sizes = {r["doc_id"]: len([w for w in r["text"].split() if w]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    blocks = {}
    for r in assembling.assembled(spark, DATA).collect():
        blocks.setdefault(r["doc_id"], []).append((r["block"], r["start"], r["end"], r["kind"]))
    for d, b in blocks.items():
        b.sort()
        assert [x[0] for x in b] == list(range(len(b))) and b[0][1] == 0 and b[-1][2] == sizes[d]
        assert all(x[2] == y[1] for x, y in zip(b, b[1:], strict=False))
    assert {k for b in blocks.values() for *_, k in b} >= {"card", "prose"} and len(blocks) == sum(n > 0 for n in sizes.values())


def test_blocks_of_one_document(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, words)], "doc long, words array<string>")
    chunks = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (1, 2, 30, 40), (1, 3, 40, 55)], "doc long, chunk long, start long, end long")
    refs = spark.createDataFrame([(1, 7, False, words[18:32], 20, 30), (1, 8, True, [], 35, 44), (1, 9, False, [], 2, 6)], "doc long, ref long, merges boolean, passage array<string>, start long, end long")
    got = [(r["kind"], r["start"], r["end"], r["chunks"], r["refs"]) for r in A.assemble(docs, chunks, refs, "doc").orderBy("block").collect()]
    assert got == [("prose", 0, 10, [0], [9]), ("prose", 10, 20, [1], []), ("card", 20, 30, [], [7]), ("prose", 30, 60, [2, 3], [8])]
    # words in no block: the card's own go to it, others to prose, else they are a block of their own
    few = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 33, 40)], "doc long, chunk long, start long, end long")
    got = [(r["kind"], r["start"], r["end"]) for r in A.assemble(docs, few, refs.where("ref = 7"), "doc").orderBy("block").collect()]
    assert got == [("prose", 0, 20), ("card", 20, 33), ("prose", 33, 60)] or got == [("prose", 0, 20), ("card", 20, 30), ("prose", 30, 60)]
    none = few.limit(0)
    assert [(r["kind"], r["start"], r["end"]) for r in A.assemble(docs, none, refs.limit(0), "doc").collect()] == [("untranslated", 0, 60)]


def test_labels_over_ranges(spark):
    p = {n: ["abcdef"[n] * 6 + "uvxyz"[k] * 3 for k in range(5)] for n in range(1, 6)}  # no near misses
    canon = spark.createDataFrame([(1, n, w) for n, w in p.items()], "group long, passage long, words array<string>")
    rows = [
        ("both", 2, p[1] + p[2], 1, 2, 10), ("ahead", 2, p[2] + p[3] + p[4], 2, 4, 15), ("partly", 3, p[3] + p[4][:4], 3, 4, 9), ("left over", 3, p[3] + ["x"] * 3, 3, 3, 5), ("two left", 3, [*p[3], "x", "y"], 3, 3, 7),
        ("lead", 2, ["a", "b", *p[2], *p[3]], 2, 3, 12), ("tail", 2, p[2][2:] + p[3], 2, 3, 8), ("other", 2, ["z"] * 6, 2, 2, 6), ("alone", 5, p[5], 5, 5, 5),
    ]
    refs = spark.createDataFrame([(k, 1, n, w) for k, n, w, *_ in rows], "ref string, group long, passage long, words array<string>")
    got = {r["ref"]: (r["first"], r["last"], r["n_words"]) for r in A.range_labels(refs, canon, "ref").collect()}
    assert got == {k: tuple(x) for k, _, _, *x in rows}


def test_windows_equal_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(60)]
    canon = [(i, rng.choices(vocab, k=rng.randint(3, 14))) for i in range(12)]
    docs = []
    for d in range(30):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            a = list(rng.choice(canon)[1])
            for _ in range(rng.randint(0, 2)):
                a[rng.randrange(len(a))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = a
        docs.append((d, w))
    want = {}
    for d, w in docs:
        for i, a in canon:
            if 5 <= len(a) <= len(w):
                best = max(((len(set(w[s : s + len(a)]) & set(a)) / len(set(w[s : s + len(a)]) | set(a)), -s) for s in range(len(w) - len(a) + 1)))
                if best[0] >= 0.65:
                    want[d, i] = -best[1]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc long, text string")
    cf = spark.createDataFrame([(i, " ".join(a)) for i, a in canon], "id long, text string")
    got = {(r["doc"], r["id"]): r["start"] for r in quotes.best_windows(df, cf, "doc", "text", "id", "text").collect()}
    assert got == want and len(want) > 10


def test_split_locations(spark):
    docs = spark.createDataFrame([(1, 39), (2, 100), (3, 100), (4, 100), (5, 100)], "doc long, n_words long")
    marks = spark.createDataFrame([(2, 50, 20.0), (4, 60, None), (1, 20, 9.0)], "doc long, word long, time double")
    gaps = spark.createDataFrame([(2, 40, 45.0, 3.0), (3, 30, 12.34, 1.2), (4, 70, 33.0, 2.0), (5, 10, 5.0, 1.1)], "doc long, word long, time double, gap double")
    got = {r["doc"]: (r["word"], r["time"], r["via"], r["validated"]) for r in A.split_location(docs, marks, gaps, "doc").collect()}
    assert got == {2: (50, 20.0, "marker", True), 3: (30, 12.3, "gap", True), 4: (60, 33.0, "marker", True)}


def test_chunks_are_placed_in_order(spark):
    t = [f"t{i}" for i in range(40)]
    rows = [(0, t[0:8]), (1, t[10:14]), (2, ["x", "y", "z"]), (3, t[20:23]), (4, t[2:6])]
    chunks = spark.createDataFrame([(1, c, w) for c, w in rows], "doc long, chunk long, words array<string>")
    series = spark.createDataFrame([(1, t)], "doc long, words array<string>")
    got = {r["chunk"]: r["word"] for r in A.chunk_starts(chunks, series, "doc").collect()}
    assert got == {0: 0, 1: 10, 2: 14, 3: 20, 4: 23}


def test_collections_are_named_on_either_side(spark):
    text = "one two three as told by bukhari end in sunan muslim from him a b c done"
    rows = N.light_rows(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text")
    spans = spark.createDataFrame([(1, 0, 3), (1, 12, 15)], "doc long, start long, end long")
    names = {"bukhari": "bukhari", "muslim": "muslim"}
    got = {(r["start"], r["collection"], r["side"]) for r in N.named_collections(spans, rows, "doc", names, "^by$", "^sunan$", "^from$", r"[.!?]$").collect()}
    assert got == {(0, "bukhari", "after"), (12, "muslim", "before")}
    assert spans.select(F.lit(1)).count() == 2
