"""Operators on groups that are long or alike: as many rounds and meetings as the rows need."""

from pyspark.sql import functions as F

from quotary.operators import assembly as A
from quotary.operators import quotes


def test_a_run_of_thousands_of_other_words(spark):
    df = spark.createDataFrame([(["aaaa"] * 4 + ["bbbb"] * 3000, ["aaaa"] * 4 + ["yyyy"] * 3000)], "want array<string>, have array<string>")
    assert df.select(quotes.tolerant_run(F.col("want"), F.col("have"), F.lit(0)).alias("ok")).first()["ok"] is False


def test_equal_passages_are_labelled_in_few_rounds(spark, monkeypatch):
    rounds, write = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, tag: rounds.append(tag) or write(df, tag))
    same, n = ["abcdef", "uvwxyz", "ghijkl", "mnopqr"], 120
    canon = spark.createDataFrame([(g, i, same) for g in (1, 2) for i in range(n)], "group long, passage long, words array<string>")
    refs = spark.createDataFrame([(f"1:{i}", 1, i, same * 2) for i in range(1, n)] + [("2", 2, n - 1, same * 2)], "ref string, group long, passage long, words array<string>")
    got = {r["ref"]: (r["first"], r["last"], r["n_words"]) for r in A.range_labels(refs, canon, "ref").collect()}
    assert set(got.values()) == {(0, 1, 8)} and len(got) == n and len(rounds) < 30


def test_tails_meet_in_buckets_and_not_in_all_pairs(spark):
    rows = [("d", i, 1, i * 10, i * 10 + (25 if i % 2 else 0), [f"w{i}", "x", *f"a{i + 1} b{i + 1} c{i + 1} d".split(), "y"] if i % 2 else f"a{i} b{i} c{i} d e".split()) for i in range(40)]
    refs = spark.createDataFrame(rows, "doc string, ref long, group long, first long, last long, words array<string>")
    tails = A.yield_tails(refs, "doc", "ref")
    got = {r["ref"]: (r["last"], r["n_words"]) for r in tails.collect()}
    assert got == {i: ((i * 10 + 9, 2) if i < 39 else (i * 10 + 25, 7)) if i % 2 else (i * 10, 5) for i in range(40)}
    plan = tails._jdf.queryExecution().optimizedPlan().toString()
    assert "_b" in plan


def test_reporting_words_take_along_only_what_is_near(spark):
    from quotary.operators import attribution as N

    said = ["as", "one", "two", "in", "the"] + ["in"] * 20_000
    rows = spark.createDataFrame([(d, said) for d in range(4)], "doc long, light array<string>")
    canon = spark.createDataFrame([("first", 7, ["one", "two"])], "collection string, passage long, words array<string>")
    quoted = N.attributed_quotes(rows, canon, "doc", "^as$", "^in$", {"the": "first"})
    assert sorted(tuple(r) for r in quoted.collect()) == [(d, 1, 3, "first", 7) for d in range(4)]
    # the document's words aren't among the columns of the exploded rows
    assert not any("light#" in line.split("]")[-2] for line in quoted._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode(transform(filter" in line)


def test_only_runs_that_are_asked_for_are_shuffled(spark, monkeypatch):
    import random

    from quotary.operators import refs

    rng, written, write = random.Random(5), {}, refs.materialize
    monkeypatch.setattr(refs, "materialize", lambda df, tag: written.setdefault(tag, write(df, tag)))
    texts = ["".join(rng.choices("abcdefgh éß", k=rng.randint(20, 200))) for _ in range(200)]
    texts += [texts[0][3:18], texts[1][5:], "é", "x" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(texts) if i != j and t in u}
    assert {(r["id"], r["held_by"]) for r in refs.contained(frame, "id", "t").collect()} == want
    assert written["offered"].count() < 8 * len(texts)


def test_anchors_of_two_readings(spark):
    from quotary.operators import grams

    rows = spark.createDataFrame([(1, [5, 6, 7, 8, 5], [6, 7, 9, 8]), (2, [1, 1], [1]), (3, [], []), (4, None, [1])], "doc int, a array<long>, b array<long>")
    got = grams.unique_anchors(rows, "doc")
    assert [tuple(r) for r in got.collect()] == [(1, 3, 2)] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_located_passages_read_documents_a_few_times(spark):
    import random

    from quotary.operators import refs

    rng = random.Random(3)
    say = lambda lo, hi: rng.choices("ab", k=rng.randint(lo, hi))
    docs, canon = {i: say(0, 60) + ["c"] * 40 for i in range(40)}, {i: say(3, 12) for i in range(60)}
    want = {}
    for d, w in docs.items():
        for p, a in canon.items():
            at = lambda x: [i for i in range(len(w) - len(x) + 1) if w[i : i + len(x)] == x]  # noqa: E731,B023
            found = next(((at(a[:n])[0], n) for n in range(min(5, len(a)), len(a) + 1) if len(at(a[:n])) == 1), None)
            found = found or next(((max(at(a[k : k + 5])[0] - k, 0), 5) for k in range(1, 5) if len(a) - k >= 5 and len(at(a[k : k + 5])) == 1), None)
            want |= {(d, p): found} if found else {}
    given = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc long, t string"), spark.createDataFrame([(p, " ".join(a)) for p, a in canon.items()], "p long, u string")
    located = refs.locate_unique(given[0], "doc", "t", given[1], "p", "u", back=4)
    assert {(r["doc"], r["p"]): (r["pos"], r["n"]) for r in located.collect()} == want and len(want) > 100
    # each scan of the documents is a parse of all their words; nor are these among the columns of a row for each place
    plan = located._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [doc") <= 1


def test_pairs_of_words_cut_a_text_once(spark):
    from quotary.functions import text as X

    share = X.pair_share(X.words(F.col("a")), X.words(F.col("b")))
    df = spark.createDataFrame([("x y z", "y z x y"), ("x", "x"), ("", "x"), (None, "x")], "a string, b string").select(share.alias("s"))
    assert [r["s"] for r in df.collect()] == [1.0, 1.0, 0.0, 0.0]
    # words made in a lambda are made again for each of them
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 2


def test_pairs_are_aligned_together(monkeypatch):
    import random

    from quotary.operators import alignment

    rng, alone = random.Random(1), []
    say = lambda most: [rng.choice([None, *"abcd"]) for _ in range(rng.randint(0, most))]
    pairs = [(say(40), say(40)) for _ in range(300)]
    want = [alignment.global_pairs(*p) for p in pairs]
    one = alignment.global_pairs
    monkeypatch.setattr(alignment, "global_pairs", lambda a, b: alone.append(len(a)) or one(a, b))
    assert alignment.global_pairs_of(pairs) == want and not alone
    monkeypatch.setattr(alignment, "CELLS", 900)  # larger tables than that are made alone
    assert alignment.global_pairs_of(pairs) == want and 0 < len(alone) < 100


def test_lookups_read_their_state_once_a_batch():
    import pandas as pd

    from quotary.streaming.streams import _Lookups

    class State:
        def __init__(self):
            self.rows, self.calls, self.one = {}, 0, None

        def iterator(self):
            self.calls += 1
            return iter([(k, v) for k, v in self.rows.items()])

        def containsKey(self, k):  # noqa: N802
            self.calls += 1
            return k in self.rows

        def getValue(self, k):  # noqa: N802
            return self.rows[k]

        def updateValue(self, k, v):  # noqa: N802
            self.rows[k] = v

        exists = lambda self: self.one is not None
        get = lambda self: self.one
        update = lambda self, v: setattr(self, "one", v)
        registerTimer = lambda self, at: None  # noqa: E731, N815

    p = _Lookups("user", "found", 2, 10, 30)
    p.known, p.used, p.handle = State(), State(), State()
    rows = [(s, u, f) for s, u, f in [(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True), (12, "b", True), (13, "a", True), (31, "a", True), (32, "c", True), (33, "d", True)]]
    batch = pd.DataFrame({"ts": pd.to_datetime([r[0] for r in rows], unit="s"), "event_id": range(len(rows)), "user": [r[1] for r in rows], "found": [r[2] for r in rows]})
    got = next(iter(p.handleInputRows((0,), iter([batch]), None)))
    assert got["verdict"].tolist() == ["looked up", "known", "looked up", "refused", "looked up", "known", "looked up", "looked up", "refused"]
    assert p.known.rows == {("a",): (61_000_000,), ("b",): (42_000_000,), ("c",): (62_000_000,)} and p.known.calls == 1


def test_shared_words_are_counted_once_a_pair(spark, monkeypatch):
    import random

    from quotary.operators import refs

    rng, written, write = random.Random(7), [], refs.materialize
    monkeypatch.setattr(refs, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    say = lambda n: " ".join(rng.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=n))
    texts, canon = [say(rng.randint(0, 14)) for _ in range(300)] + ["Zz -- w1"], [say(rng.randint(1, 10)) for _ in range(40)]
    t, c = spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame(list(enumerate(canon)), "p int, c string")
    for least, contained in ((0.4, True), (0.5, False), (0.75, True)):
        want = {}
        for i, x in enumerate(texts):
            for p, y in enumerate(canon):
                a, b = ({w for w in z.lower().split() if w != "--"} for z in (x, y))
                if a and b and a & b and (len(a & b) >= least * len(a) or (contained and len(a & b) == len(b))):
                    want[i, p] = (len(a & b), len(a), len(b))
        got = refs.alike_pairs(t, ["id"], "t", c, "p", "c", least, contained)
        assert {(r["id"], r["p"]): (r["s"], r["n"], r["m"]) for r in got.collect()} == want
    # texts are read for one table, and pairs are scored from one count of their words
    assert written == ["known"] * 3
    plan = refs.best_match(t, ["id"], "t", c, "p", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1 and "split(t#" not in plan


def test_bodies_are_compared_word_for_word_only_if_alike(spark):
    from quotary.operators import refs

    t = spark.createDataFrame([(1, "one two (aside) three four five six seven"), (2, "other words"), (3, "one two"), (4, "(one)"), (5, None)], "id int, t string")
    c = spark.createDataFrame([(7, "one two three four five six seven"), (8, "one two three x y z"), (9, "-")], "p int, c string")
    got = refs.best_body(t, ["id"], "t", c, "p", "c")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 1.0), (3, 8, 0.33)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("LeftSemi") == 1


def test_layers_read_documents_once(spark):
    from quotary.plans import matching

    assert "split(" not in matching.tagged_layers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_openings_are_placed_by_one_reading(spark, monkeypatch):
    import random

    from quotary.operators import refs

    rng, written, write = random.Random(11), [], refs.materialize
    monkeypatch.setattr(refs, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    docs, canon = {i: rng.choices("abc", k=rng.randint(0, 60)) for i in range(60)}, {i: rng.choices("abc", k=rng.randint(0, 9)) for i in range(40)}
    want = {}
    for d, w in docs.items():
        for p, a in canon.items():
            for n in (3, 4, 5, 6):
                at = [i for i in range(len(w) - n + 1) if w[i : i + n] == a[:n] and i > 0.25 * len(w)] if len(a) >= n else []
                if at:
                    want[d, p] = (n, at[0])
    frame = lambda rows, k: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{k} int, t string")
    got = refs.locate_openings(frame(docs, "d"), "d", "t", frame(canon, "p"), "p", "t")
    assert {(r["d"], r["p"]): (r["n"], r["pos"]) for r in got.collect()} == want and written == ["openings"]


def test_rows_are_compared_with_themselves_together(spark, monkeypatch):
    import random

    from quotary.operators import chunks

    calls, one = [], chunks._repeated
    monkeypatch.setattr(chunks, "_repeated", lambda w, n, within: calls.append(len(w)) or one(w, n, within))
    rng = random.Random(13)
    texts = [["", "a", "b", "c"][: rng.randint(2, 4)] for _ in range(80)]
    texts = [rng.choices(k, k=rng.randint(0, 90)) for k in texts] + [["a"] * 3, [], ["a"] * 50]
    want = [chunks.repeated_runs(t, 5, 30) for t in texts]
    calls.clear()
    ids = {"": 0, "a": 5, "b": -6, "c": 7}
    import pyarrow as pa

    for together in (1 << 19, 100):
        monkeypatch.setattr(chunks, "TOGETHER", together)
        got = chunks.repeats_of(5, 30).func(pa.array([[ids[x] for x in t] for t in texts], pa.list_(pa.int64()))).to_pylist()
        assert got == want
    assert len(calls) < 1 + len(texts)


def test_lost_words_are_counted_in_one_go(spark):
    from quotary.operators import audit

    frame = lambda rows: spark.createDataFrame(rows, "id int, t string")
    got = audit.word_coverage(frame([(1, "a a b -"), (2, "x"), (3, None), (4, "same")]), frame([(1, "a b b c"), (5, "y y"), (4, "same")]), "id", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 2), (2, 1, 0), (4, 0, 0), (5, 0, 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_documents_without_an_anchor_are_not_written(spark, monkeypatch):
    from quotary.functions.lang import LATIN

    written, write = {}, quotes.materialize
    monkeypatch.setattr(quotes, "materialize", lambda df, tag: written.setdefault(tag, write(df, tag)))
    canon = spark.createDataFrame([(0, 1, "one two three four five six seven")], "group long, passage long, text string")
    docs = spark.createDataFrame([(i, f"a{i} b{i} " + ("One two three four five, six seven" if i % 50 == 0 else "one two three so far") + f" c{i}") for i in range(500)] + [(None, "one two three four five")], "doc long, text string")
    spans = quotes.find_spans(docs, canon, "doc", "text", LATIN)
    want = {(i, 2, 9) for i in range(0, 500, 50)}
    assert {(r["doc"], r["start"], r["end"]) for r in spans.collect()} == want
    assert {r["doc"] for r in written["words"].collect()} == {d for d, _, _ in want}
    kept = quotes.drop_borrowed(spans, docs, canon, "doc", "text", LATIN)
    assert {(r["doc"], r["start"], r["end"]) for r in kept.collect()} == want
    assert written["judged"].count() == len(want)


def test_labels_meet_their_passages_once(spark, monkeypatch):
    written, write = [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    monkeypatch.setattr(A, "TEXTS", 40)
    text = {p: [f"{c}{p}{p}{p}" for c in "abcde"] for p in range(1, 200)}
    canon = spark.createDataFrame([(1, p, w) for p, w in text.items()], "group int, passage int, words array<string>")
    refs = spark.createDataFrame([(f"{p}:{i}", 1, p + i, text[p] + text[p + 1] + text.get(p + 2, [])[:4]) for p in range(1, 199) for i in (0, 1)] + [("none", 1, 500, ["a"]), ("no words", 1, 1, [])], "ref string, group int, passage int, words array<string>")
    labels = A.range_labels(refs, canon, "ref")
    assert {(r["ref"], r["first"], r["last"], r["n_words"]) for r in labels.collect()} == {(f"{p}:{i}", p, min(p + 2, 199), 14 if p < 198 else 10) for p in range(1, 199) for i in (0, 1)}
    # one table, whatever the rounds of a step back and of steps ahead
    assert written == ["labels"] and dict(labels.dtypes)["first"] == "int"


def test_labels_go_on_beyond_a_shelf(spark, monkeypatch):
    written, write, n = [], A.materialize, 1500
    monkeypatch.setattr(A, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    same = ["abcdef", "uvwxyz", "ghijkl", "mnopqr"]
    own = [[f"{c}{p}{c}{p}" for c in "abcd"] for p in range(n)]
    canon = spark.createDataFrame([(1, p, same) for p in range(n)] + [(2, p, w) for p, w in enumerate(own)], "group long, passage long, words array<string>")
    refs = spark.createDataFrame([(f"same {p}", 1, p, same * 2) for p in range(1, n)] + [("all", 2, 1, sum(own, [])), ("few", 2, 1023, own[1023] + own[1024] + ["x"])], "ref string, group long, passage long, words array<string>")
    got = {r["ref"]: (r["first"], r["last"], r["n_words"]) for r in A.range_labels(refs, canon, "ref").collect()}
    assert got == {f"same {p}": (0, 1, 8) for p in range(1, n)} | {"all": (0, n - 1, 4 * n), "few": (1023, 1024, 9)} and len(written) < 8


def test_words_are_heard_in_lists_as_in_columns(spark):
    import random

    rng, hearing = random.Random(17), quotes.Hearing()
    word = lambda: None if rng.random() < 0.03 else "".join(rng.choices("abé", k=rng.randint(0, 6)))
    rows = []
    for i in range(1500):
        want = [word() for _ in range(rng.randint(0, 12))]
        have = [word() for _ in range(rng.randint(0, 2))] + [w if w is None or rng.random() < 0.8 else w + rng.choice(["", "a", "ab"]) for w in want] + [word()]
        rows.append((i, want, have, rng.randint(-1, 3), rng.randint(0, 2)))
    df = spark.createDataFrame(rows, "i int, want array<string>, have array<string>, at int, skip int")
    heard = {r["i"]: r["ok"] for r in df.select("i", quotes.tolerant_run(F.col("want"), F.col("have"), F.col("at"), F.col("skip")).alias("ok")).collect()}
    assert heard == {i: hearing.stands(w, k, len(w), h, at) for i, w, h, at, k in rows} and 100 < sum(heard.values()) < 1400


def _plain_lookups(batches, most, span, keep, late):
    known, at, used, newest, out = {}, None, 0, None, []
    for rows in batches:
        rows = [r for r in rows if newest is None or r[1] > newest - late]
        for i, t, a, f in sorted(rows, key=lambda r: (r[1], r[0], r[2], bool(r[3]))):
            if known.get(a, t) > t:
                out.append((i, t, a, "known"))
                continue
            at, used = (at, used) if t // span == at else (t // span, 0)
            out.append((i, t, a, "looked up" if used < most else "refused"))
            if used < most:
                used += 1
                if f:
                    known[a] = t + keep
        newest = max([r[1] for r in rows] + [newest or 0])
    return sorted(out)


def test_lookups_ask_only_what_may_be_looked_up(spark, monkeypatch, tmp_path):
    import datetime
    import random

    from quotary.streaming import streams

    rng, start, real, seen = random.Random(19), datetime.datetime(2024, 1, 1), streams._ask, tmp_path / "seen"
    seen.mkdir()

    def spy(*a):
        run = real(*a)

        def count(batches):
            for b in batches:
                with open(seen / "rows", "a") as f:
                    f.write(f"{b.num_rows}\n")
                yield b

        return lambda batches: run(count(batches))

    monkeypatch.setattr(streams, "_ask", spy)
    schema = "event_id int, ts timestamp, a string, found boolean"
    for n, (most, span, keep, names, size) in enumerate([(2, 3000, 500, 6, 500), (2, 10_000, 40_000, 3, 900)]):
        monkeypatch.setattr(streams, "ASKED", 3)
        # in the second batch some rows are late; some rows are there twice
        rows = sorted(((rng.randrange(20_000), i % 7, rng.choice("abc") + str(rng.randrange(names)), rng.choice([True, True, False, None])) for i in range(size)), key=lambda r: r[0])
        parts = [rows[: size // 2] + rows[:20], rows[size // 2 :] + rows[size // 2 - 150 : size // 2]]
        at = tmp_path / f"in{n}"
        for p in parts:
            spark.createDataFrame([(i, start + datetime.timedelta(seconds=t), a, f) for t, i, a, f in p], schema).coalesce(1).write.mode("append").parquet(str(at))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
        got = streams.run_lookups(stream, "a", "found", most=most, span=span, keep=keep, late="2 minutes").collect()
        zero = int(start.timestamp())
        want = _plain_lookups([[(i, t + zero, a, f) for t, i, a, f in p] for p in parts], most, span, keep, 120)
        assert sorted((r["event_id"], int(r["ts"].timestamp()), r["a"], r["verdict"]) for r in got) == want and len({w[-1] for w in want}) == 3
    # most rows of a span don't go through the one task
    (seen / "rows").unlink()
    monkeypatch.setattr(streams, "ASKED", 16)
    many = [(i, start + datetime.timedelta(seconds=i % 3600), f"a{i}", True) for i in range(20_000)]
    spark.createDataFrame(many, schema).coalesce(1).write.parquet(str(tmp_path / "many"))
    got = streams.run_lookups(spark.readStream.schema(schema).parquet(str(tmp_path / "many")), "a", "found", most=5, span=3600, keep=60)
    assert got.where("verdict = 'looked up'").count() == 5 and got.count() == 20_000
    assert sum(map(int, (seen / "rows").read_text().split())) == 80
