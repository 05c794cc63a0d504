"""Spelling variants, importance resampling and neighbours by binary codes against brute force and on odd input."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotary.llm import hamming, importance, variants

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long, rank int"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "clash", -1, -1) for i, t in rows], DOCS)


# spelling variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=variants.TIMES):
    form = {}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_one_edit():
    words = ["".join(x) for n in range(1, 5) for x in itertools.product("abÿ", repeat=n)]
    for a, b in random.Random(1).sample(list(itertools.product(words, words)), 6000):
        assert variants.one_edit(a, b) == one_apart(a, b)


def test_search_finds_every_pair_of_a_branch():
    rng = random.Random(2)
    words = {"".join(rng.choice("ab×") for _ in range(rng.randint(7, 8))) for _ in range(700)}
    words |= {"x" * 60, "x" * 61, "x" * 30 + "y" + "x" * 30, "x" * 300, "x" * 299, "yx" * 24, "yx" * 23 + "y"}
    words = sorted(words)
    rng.shuffle(words)
    group = variants.grouping(np.bincount(np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), 255), minlength=256), 6)
    twice = words + words
    state = np.array([variants.MEMBER] * len(words) + [variants.FRESH] * len(words), np.int8)
    pairs = variants.Search(twice, variants.vectors(twice, group, 6), state).run(0)
    got = [frozenset((twice[a], twice[b])) for a, b in pairs]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_apart(*p)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


@pytest.mark.parametrize("rows", [60_000, 40])
def test_variants_equal_brute_force(spark, monkeypatch, rows):
    """Also where branches and leaves hold more rows than a group may: then they are walked further and tiled."""
    monkeypatch.setattr(variants, "ROWS", rows)
    rng, counts = random.Random(3), {}
    for _ in range(250):
        base = "".join(rng.choice("abcdeé") for _ in range(8))
        counts[base] = rng.choice([2, 3, 500, 5000])
        for _ in range(3):
            i, other = rng.randrange(8), rng.choice("abcdeéz")
            counts.setdefault(rng.choice([base[:i] + base[i + 1 :], base[:i] + other + base[i:], base[:i] + other + base[i + 1 :]]), rng.choice([2, 3, 40, 50]))
    counts |= dict.fromkeys({"".join(p) for p in itertools.permutations("abcdefg")}, 2)  # many words of one vector
    counts |= {"zzzzzzzz": 2, "zzzzzzzzz": 20, "zzzzzzzzzz": 200, "y" * 20_000: 2, "y" * 20_001: 30}
    counts = dict(sorted(counts.items())[:: 1 if rows > 40 else 4]) | {"y" * 20_000: 2, "y" * 20_001: 30}
    vocabulary = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    got = variants.variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain_variants(counts)


def test_words_are_damaged_by_their_checksum(spark):
    rows = [(i, f"Wörterbuch-{'abcdefgh'[i % 8] * 7} STRASSENBAHN straßenbahn ×÷÷÷÷÷÷÷ kurz {'Q' * 5000}q") for i in range(200)]
    rows += [(7, None), (8, ""), (None, "Nullschlüssel Nullschlüssel"), (9, rows[9][1])]
    want = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                want[word] += 1
    got = {r["word"]: r["n"] for r in variants.damaged_words(docs_of(spark, rows)).collect()}
    assert got == want and any(len(w) == 9 for w in got)


def test_variants_of_odd_tables(spark):
    assert variants.spelling_variants(docs_of(spark, [])).count() == 0
    assert variants.spelling_variants(docs_of(spark, [(1, None), (2, ""), (None, "kurz")])).count() == 0
    got = variants.spelling_variants(docs_of(spark, [(1, "einhorn einhorn"), (1, "einhorn einhorn")])).collect()
    assert [(r["word"], r["n"], r["n_near"], r["form"], r["root"]) for r in got] == [("einhorn", 4, 0, None, "einhorn")]


# importance resampling


def plain_features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))
    return w, [*w, *(f"{a} {b}" for a, b in itertools.pairwise(w))]


def plain_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % importance.BUCKETS
    s, t = (collections.Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in docs], target))
    total_s, total_t, n = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + n) / ((s[b] + 1.0) * (total_t + n))))
    rows = []
    for key, text in docs:
        w, f = plain_features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 25 // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in rows)


def random_text(rng, n):
    return " ".join(rng.choice(["The", "of", "a1", "Ähre", "漢字", "x" * 70, "über", "it's", "o b", f"w{rng.randrange(400)}", "A" * 50]) for _ in range(n))


@pytest.mark.parametrize("piece", [1, 40, 300, 1 << 22])
def test_features_of_pieces(piece):
    """Also where pieces are shorter than words; every feature is there once, whether its words are of the head or not."""
    rng = random.Random(8)
    texts = [random_text(rng, n) for n in (0, 1, 3, 40, 200)] + ["", "...", "z" * 700 + " b " * 30 + "z" * 100, " " * 500 + "a b"]
    head = importance.Head([b"the", b"of", b"o", "ähre".encode(), b"w1", b"w2"], importance.BUCKETS)
    got = [collections.Counter() for _ in texts]
    words = collections.Counter()
    for joined, starts, owners, again in importance.pieces([t.encode() for t in texts], piece):
        for bucket, part, is_word in zip(*importance.features(joined, starts, again, head), strict=True):
            got[owners[part]][int(bucket)] += 1
            words[int(owners[part])] += int(is_word)
    for i, text in enumerate(texts):
        w, f = plain_features(text)
        assert got[i] == collections.Counter(zlib.crc32(x.encode()) % importance.BUCKETS for x in f) and words[i] == len(w)


@pytest.mark.parametrize("head", [importance.HEAD, 30])
def test_draw_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(importance, "HEAD", head)
    monkeypatch.setattr(importance, "PAIRED", min(head, 1024) // 6)
    rng = random.Random(4)
    docs = [(i, random_text(rng, rng.choice([0, 1, 5, 19, 20, 21, 200]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (203, random_text(rng, 20_000)), (None, random_text(rng, 30)), (5, docs[5][1]), (5, docs[5][1]), (204, "z" * 5000 + " b " * 30 + "z" * 100)]
    target = [random_text(rng, 50) for _ in range(4)] + [None, ""]
    frame = spark.createDataFrame([(x, -1) for x in target], "text string, doc_id long")
    got = importance.resample(docs_of(spark, docs), frame).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_draw(docs, target)


def test_draw_of_odd_tables(spark):
    none = docs_of(spark, [])
    assert importance.resample(none, none).count() == 0
    docs = [(i, "one two " * 12) for i in range(9)]
    assert collections.Counter(tuple(r) for r in importance.resample(docs_of(spark, docs), none).collect()) == plain_draw(docs, [])


def test_crc_of_joined_texts():
    rng = np.random.default_rng(5)
    a, b = [rng.integers(0, 256, n, np.uint8).tobytes() for n in range(49)], [rng.integers(0, 256, n, np.uint8).tobytes() for n in range(49)]
    crc = lambda x: np.array([zlib.crc32(v) for v in x], np.uint32)
    assert (importance._joined(crc(a), crc(b), np.arange(49)) == crc([x + y for x, y in zip(a, b, strict=True)])).all()
    assert (importance._spaced(crc(a)) == crc([x + b" " for x in a])).all()


# neighbours by binary codes


def plain_nearest(rows, every=20, k=20):
    """{query: [(id, score)]} by comparing all, sums in order of components."""
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in rows]
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        v = max((tuple(v) for i, v in rows if i == q))
        scores = []
        for i, x in rows:
            if i != q:
                total = 0.0
                for d in range(width):
                    total += float(x[d]) * v[d]
                scores.append((i, total))
        out[q] = sorted(scores, key=lambda s: (-s[1], s[0]))[:k]
    return out


def recall_of(got, want):
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == {q for q, x in want.items() if x}
    hit = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        scores = collections.Counter(s for _, s in want[q])
        hit += sum((scores & collections.Counter(r["score"] for r in rows)).values())
        total += len(rows)
    return hit / total


def test_op11_finds_the_nearest(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert recall_of(hamming.op11_neighbours(spark, DATA).collect(), plain_nearest(rows)) >= 0.95


@pytest.mark.parametrize("rows", [16_384, 300])
def test_neighbours_of_vectors_of_many_lengths(spark, monkeypatch, rows):
    """Norms from 0.1 to 10, clusters, a vector that a third of the rows hold, rows that repeat an id; blocks and tiles."""
    monkeypatch.setattr(hamming, "ROWS", rows)
    monkeypatch.setattr(hamming, "TILE", 60)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1800)] + 0.4 * rng.normal(size=(1800, 24))) * np.exp(rng.uniform(-2.3, 2.3, (1800, 1)))
    x[::3] = x[1]
    data = [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))] + [(40, [1.0] * 24), (41, [0.5] * 24), (41, [0.5] * 24)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    assert recall_of(hamming.search(frame).collect(), plain_nearest(data)) >= 0.9


def test_odd_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [3.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [-1.0, -1.0, 4.0]), (8, [1.0, 2.0]), (40, [0.0])]
    sound = [(0, [1.0, 2.0]), (20, [3.0]), (7, [-1.0, -1.0, 4.0]), (8, [1.0, 2.0])]
    got = hamming.search(spark.createDataFrame(rows, shape)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(q, i + 1, v, s) for q, found in plain_nearest(sound).items() for i, (v, s) in enumerate(found)}
    assert hamming.search(spark.createDataFrame([], shape)).count() == 0
    assert hamming.search(spark.createDataFrame([(1, [1.0])], shape)).count() == 0
    assert hamming.search(spark.createDataFrame([(20, [1.0])], shape)).count() == 0
    assert hamming.search(spark.createDataFrame([(20 * i, [1.0, 0.0]) for i in range(30)], shape)).count() == 600


@pytest.mark.parametrize("part", [8, 16])
def test_probing_retrieves_every_code_within_the_radius(part):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 256, (900, 16), np.uint8)
    codes[:500] = codes[0] ^ np.packbits(rng.random((500, 128)) < rng.random((500, 1)) * 0.3, axis=1)
    kind = np.uint16 if part == 16 else np.uint8
    index = hamming.Index(codes.view(kind), part)
    far = np.bitwise_count(codes ^ codes[0]).sum(1)
    for radius in (0, 1, 5, 7, 8, 12, 16, 23, 40, 64, 128):
        rows, found = index.within(codes.view(kind)[0], radius)
        assert rows.tolist() == np.flatnonzero(far <= radius).tolist() and (found == far[rows]).all()


def test_lists_of_uneven_lengths_become_rows():
    column = pa.array([[9.0], [1.0, 2.0, 3.0], [], [4.0]], pa.list_(pa.float64())).slice(1)
    assert hamming.matrix(column, 3).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]
