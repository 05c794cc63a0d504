"""Alignment kernels against tables of all places, and the columns made of them on odd rows."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from quotary.operators import alignment as A


def lcs_by_table(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] is not None and a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] is not None and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def global_by_table(a, b):
    n, m = len(a), len(b)
    t = {(i, 0): -i for i in range(n + 1)} | {(0, j): -j for j in range(m + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = max(t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1, j] - 1, t[i, j - 1] - 1)
    i, j, out = n, m, []
    while i and j:
        if t[i, j] == t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            if a[i - 1] == b[j - 1]:
                out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif t[i, j] == t[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def sequences(seed, n=150, most=40):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefghijklmnop"[: rng.randint(1, 16)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, most))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, most))]
        yield a, b


@pytest.mark.parametrize("bits", [8, 8192])
def test_lcs_is_that_of_the_table(monkeypatch, bits):
    monkeypatch.setattr(A, "BITS", bits)
    monkeypatch.setattr(A, "_ALL", (1 << bits) - 1)
    for a, b in sequences(1):
        want = lcs_by_table(a, b)
        assert A.lcs(a, b) == want and A.lcs_length(a, b) == len(want)
    assert A.lcs([None, "a", None], [None, "a", None]) == [(1, 1)]


def test_global_alignment_is_that_of_the_table():
    for a, b in sequences(2):
        assert A.global_pairs(a, b) == global_by_table(a, b)


def test_long_texts_need_no_table():
    rng = random.Random(3)
    a = [rng.randrange(3000) for _ in range(20_000)]
    b = [x for x in a if rng.random() > 0.05]
    b[5000:5000] = a[100:400]
    tracemalloc.start()
    hits = A.lcs(a, b)
    pairs = A.global_pairs(a[:4000], b[:4000])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(b) - 400 < len(hits) <= len(b) and len(pairs) > 3500 and most < 60e6
    assert all(a[i] == b[j] for i, j in hits) and hits == sorted(set(hits))


def test_longest_ordered_run():
    rng = random.Random(4)
    for _ in range(300):
        v = [rng.choice([None, *range(8)]) for _ in range(rng.randint(0, 14))]
        got = A.longest_ordered(v)
        kept = [x for x in got if x is not None]
        assert kept == sorted(kept) and all(x is None or x == y for x, y in zip(got, v, strict=True))
        best, seen = 0, [x for x in v if x is not None]
        for mask in range(1 << len(seen)):
            some = [x for i, x in enumerate(seen) if mask >> i & 1]
            best = max(best, len(some)) if some == sorted(some) else best
        assert len(kept) == best


def test_words_in_a_silence_keep_to_their_sentence():
    words = ["so", "it", "ended.", "Then", "he", "rose"]
    assert A.fill([10.0, None, None, None, None, 40.0], words) == pytest.approx([10, 10.45, 10.9, 39.1, 39.55, 40])
    assert A.fill([10.0, None, None, None, None, 15.0], words) == [10, 11, 12, 13, 14, 15]
    assert A.fill([None, 10.0, None, None, 40.0, None], ["a"] * 6) == [10, 10, 20, 30, 40, 40]
    assert A.fill([None, None], ["a", "b"]) is None


def test_moved_words_are_lost_and_doubled(spark):
    """A count of words would pass a text whose words are all there in another order."""
    rows = spark.createDataFrame([(1, "a b c d e f".split(), "d e f a b c".split()), (2, ["x", "y"], ["x", "y"]), (3, [], ["z"]), (4, None, ["z"]), (5, ["q"], [])], "id int, a array<string>, b array<string>")
    got = A.sequence_coverage(rows, ["id"], F.col("a"), F.col("b")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "doubled", 3, 3, "fail"), (1, "lost", 0, 3, "fail"), (3, "doubled", 0, 1, "warn"), (5, "lost", 0, 1, "warn")]
    assert {r["id"]: (r["said"], r["extra"]) for r in A.heard_shares(rows.where("id <> 4"), ["id"], F.col("a"), F.col("b")).collect()} == {1: (0.5, 1.0), 2: (1.0, 1.0), 3: (0.0, 1.0), 5: (0.0, 0.0)}


def test_times_come_from_the_first_source_that_has_them_and_stay_in_order(spark):
    shown, one, two = "we met on a cold day".split(), "we met a day".split(), "met on cold cold day".split()
    rows = spark.createDataFrame([(1, shown, one, [1.0, 2.0, 9.0, 4.0], two, [0.5, 2.5, 3.0, 3.5, 5.0])], "id int, d array<string>, a array<string>, s array<double>, b array<string>, t array<double>")
    got = A.transferred_times(rows, ["id"], F.col("d"), F.col("d"), [(F.col("a"), F.col("s")), (F.col("b"), F.col("t"))]).first()
    # the 9 of "a" breaks the order
    assert got["anchors"] == [1, 2, 2.5, None, 3.5, 4] and got["times"] == [1, 2, 2.5, 3, 3.5, 4]


def test_a_common_word_far_off_is_no_part_of_what_was_recited():
    passage = "of old men and of the sea they spoke at length and then of the wide plain".split()
    assert A.recited("he said of the wide plain and left".split(), [passage]) == [(13, 16)]
    assert A.recited("they spoke at length".split(), [passage, "no word".split(), ["at"]]) == [(7, 10), None, None]
    assert A.recited([], [passage, []]) == [None, None]
