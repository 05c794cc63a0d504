"""Alignments of word sequences: lost and doubled words, shares heard, times carried over, spans recited.

The kernels work on one pair of sequences at a time, inside Arrow UDFs over array columns: no shuffle, and nothing but the
two sequences of a row is held. None keeps a table of all places by all places: rows of the alignment are recomputed from
checkpoints, a square root of their number apart.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of the second sequence that one integer of the bit-parallel alignment holds.
BITS = 8192
_ALL = (1 << BITS) - 1
#: Scores of the global alignment, the pace of speech in seconds a word, the seconds a word over which a gap
#: between anchors holds a silence, the ends of sentences, and the words that a passage's gap may exceed the speaker's.
MATCH, MISMATCH, GAP = 2, -1, -1
PACE, SILENT = 0.45, 1.5
ENDS_SENTENCE = re.compile(r"[.؟!?:]$")
STRAY = 3
#: Cells of the tables that are held at once where pairs of sequences are aligned together.
CELLS = 1 << 22


class _Rows:
    """Rows of the longest-common-subsequence table of the ends of two sequences, as bits (Hyyrö 2004): bit p of row r
    is 0 where a common subsequence of the last r words of `a` with the last p + 1 of `b` is longer than with the last p."""

    def __init__(self, a: list, b: list):
        self.a, self.b, self.masks = a, b, []
        known = set(a)
        for lo in range(0, len(b), BITS):
            masks: dict = {}
            for p, w in enumerate(b[len(b) - 1 - q] for q in range(lo, min(lo + BITS, len(b)))):
                if w is not None and w in known:
                    masks[w] = masks.get(w, 0) | 1 << p
            self.masks.append(masks)

    def after(self, row: list[int], first: int, last: int) -> Iterator[list[int]]:
        """Rows first + 1 to last, from row `first`."""
        for r in range(first, last):
            w, carry, out = self.a[len(self.a) - 1 - r], 0, []
            for v, masks in zip(row, self.masks, strict=True):
                used = v & masks.get(w, 0)
                total = v + used + carry
                carry = total >> BITS
                out.append(total & _ALL | v - used)
            row = out
            yield row

    def length(self, row: list[int], j: int) -> int:
        """The length at b[j:] of the row."""
        whole, part = divmod(len(self.b) - j, BITS)
        n = whole * BITS - sum(v.bit_count() for v in row[:whole])
        return n + part - (row[whole] & (1 << part) - 1).bit_count() if part else n


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence. None matches nothing."""
    rows, last = _Rows(a, b), None
    for last in rows.after([_ALL] * len(rows.masks), 0, len(a)):
        pass
    return rows.length(last, 0) if last is not None and b else 0


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, from the front: equal words meet; else a word of `a` is passed over if
    the rest is no worse without it, and if it's worse a word of `b`. None matches nothing."""
    i = 0
    while i < min(len(a), len(b)) and a[i] is not None and a[i] == b[i]:
        i += 1
    hits, skip = [(k, k) for k in range(i)], i
    a, b = a[i:], b[i:]
    rows, n, m, i, j = _Rows(a, b), len(a), len(b), 0, 0
    if not n or not m:
        return hits
    step = isqrt(n) + 1
    row = [_ALL] * len(rows.masks)
    marks = [row]
    for k in range(0, n, step):
        for row in rows.after(row, k, min(k + step, n)):
            pass
        marks.append(row)
    held, base = [], n
    while i < n and j < m:
        r = n - i
        if not base < r <= base + len(held) - 1:  # rows of the next stretch, from its checkpoint
            base = (r - 1) // step * step
            held = [marks[base // step], *rows.after(marks[base // step], base, min(base + step, n))]
        if a[i] is not None and a[i] == b[j]:
            hits.append((skip + i, skip + j))
            i, j = i + 1, j + 1
        elif rows.length(held[r - 1 - base], j) >= rows.length(held[r - base], j + 1):
            i += 1
        else:
            j += 1
    return hits


def _numbered(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = {}
    number = lambda x: np.array([ids.setdefault(w, len(ids)) for w in x], np.int64)
    return number(a), number(b)


def global_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of equal words that a global alignment sets beside each other, from the back: a pair of words goes before a gap
    in `b`, and that before a gap in `a`, where scores are equal."""
    x, y = _numbered(a, b)
    n, m = len(x), len(y)
    if not n or not m:
        return []
    ramp = np.arange(m + 1)

    def row(i: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of row i + 1 and where each comes from: 0 a pair, 1 from above, 2 from the left."""
        pair = above[:-1] + np.where(y == x[i], MATCH, MISMATCH)
        up = above[1:] + GAP
        first = np.concatenate([[GAP * (i + 1)], np.maximum(pair, up)])
        best = np.maximum.accumulate(first - GAP * ramp) + GAP * ramp  # the left one with a gap, all along the row
        return best, np.where(best[1:] == pair, 0, np.where(best[1:] == up, 1, 2)).astype(np.int8)

    step = isqrt(n) + 1
    marks = [GAP * ramp]
    for k in range(0, n, step):
        scores = marks[-1]
        for i in range(k, min(k + step, n)):
            scores, _ = row(i, scores)
        marks.append(scores)
    hits, i, j, base, ways = [], n, m, n, []
    while i > 0 and j > 0:
        if not base < i <= base + len(ways):
            base = (i - 1) // step * step
            scores, ways = marks[base // step], []
            for k in range(base, min(base + step, n)):
                scores, way = row(k, scores)
                ways.append(way)
        way = ways[i - 1 - base][j - 1]
        if way == 0:
            if a[i - 1] == b[j - 1]:
                hits.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif way == 1:
            i -= 1
        else:
            j -= 1
    return hits[::-1]


def global_pairs_of(pairs: list[tuple[list, list]]) -> list[list[tuple[int, int]]]:
    """`global_pairs` of each pair. Those of like lengths are aligned together, a row of all their tables at a time, as many as CELLS
    hold; a pair whose own table is larger is aligned alone."""
    out: list[list[tuple[int, int]]] = [[] for _ in pairs]
    size = lambda k: (max(map(len, pairs[k])), len(pairs[k][0]))
    todo, at = sorted((k for k, (a, b) in enumerate(pairs) if a and b), key=size), 0
    while at < len(todo):
        to, n, m = at, 0, 0
        while to < len(todo):
            n2, m2 = max(n, len(pairs[todo[to]][0])), max(m, len(pairs[todo[to]][1]))
            if (to + 1 - at) * n2 * m2 > CELLS:
                break
            to, n, m = to + 1, n2, m2
        if to == at:
            out[todo[at]] = global_pairs(*pairs[todo[at]])
            at += 1
            continue
        some, ids = todo[at:to], {}
        at = to
        x, y = np.full((len(some), n), -1, np.int32), np.full((len(some), m), -2, np.int32)
        for r, k in enumerate(some):
            for z, words in zip((x, y), pairs[k], strict=True):
                z[r, : len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        ramp = GAP * np.arange(m + 1, dtype=np.int32)
        scores, ways = np.tile(ramp, (len(some), 1)), np.empty((n, len(some), m), np.int8)
        for i in range(n):  # what fills up a shorter pair's table lies beyond its last row and place, which nothing before them reads
            pair = scores[:, :-1] + np.where(y == x[:, i, None], np.int32(MATCH), np.int32(MISMATCH))
            up = scores[:, 1:] + np.int32(GAP)
            scores = np.empty_like(scores)
            scores[:, 0], scores[:, 1:] = GAP * (i + 1), np.maximum(pair, up)
            scores = np.maximum.accumulate(scores - ramp, axis=1) + ramp
            ways[i] = np.where(scores[:, 1:] == pair, 0, np.where(scores[:, 1:] == up, 1, 2))
        r, i, j = np.arange(len(some)), np.array([len(pairs[k][0]) for k in some]), np.array([len(pairs[k][1]) for k in some])
        met = np.full(x.shape, -1)
        while len(r):
            way = ways[i - 1, r, j - 1]
            same = (way == 0) & (x[r, i - 1] == y[r, j - 1])
            met[r[same], i[same] - 1] = j[same] - 1
            i, j = i - (way != 2), j - (way != 1)
            on = (i > 0) & (j > 0)
            r, i, j = r[on], i[on], j[on]
        for k, row in zip(some, met, strict=True):
            have = np.flatnonzero(row >= 0)
            out[k] = list(zip(have.tolist(), row[have].tolist(), strict=True))
    return out


def longest_ordered(values: list[float | None]) -> list[float | None]:
    """The values of a longest run that never falls, by patience sorting; the others become null. Of equally long runs the one whose
    elements were reached last."""
    tops, at, before = [], [], {}
    for k, v in enumerate(values):
        if v is not None:
            lo = bisect_right(tops, v)
            tops[lo : lo + 1], at[lo : lo + 1] = [v], [k]
            before[k] = at[lo - 1] if lo else None
    keep, k = set(), at[-1] if at else None
    while k is not None:
        keep.add(k)
        k = before[k]
    return [v if k in keep else None for k, v in enumerate(values)]


def fill(times: list[float | None], words: list[str] | None) -> list[float] | None:
    """Times between anchors on the line between them; before the first and after the last the nearest anchor's. Where a gap is longer than
    SILENT seconds a word, it holds a silence: words up to its last sentence end follow the anchor before at PACE,
    the rest leads to the one after. None without an anchor."""
    anchors = [k for k, t in enumerate(times) if t is not None]
    if not anchors:
        return None
    out = list(times)
    out[: anchors[0]] = [times[anchors[0]]] * anchors[0]
    out[anchors[-1] :] = [times[anchors[-1]]] * (len(times) - anchors[-1])
    ends = lambda k: bool(ENDS_SENTENCE.search(words[k] or ""))
    for p, q in zip(anchors, anchors[1:], strict=False):
        a, b, split = times[p], times[q], None
        if words is not None and b - a > (q - p) * SILENT:
            split = next((k for k in range(q - 1, p - 1, -1) if ends(k)), None)
        for k in range(p + 1, q):
            out[k] = a + (b - a) * (k - p) / (q - p) if split is None else a + (k - p) * PACE if k <= split else b - (q - k) * PACE
    return out


def recited(said: list[str], passages: list[list[str]]) -> list[tuple[int, int] | None]:
    """First and last word of each passage that was said: a common subsequence with all passages in order, without stray hits,
    grown at both ends while the next word is the speaker's next; null with fewer hits than three, or than half of a passage of under six words."""
    keys = [(v, i, k or None) for v, p in enumerate(passages) for i, k in enumerate(p)]
    hits: list[list[tuple[int, int]]] = [[] for _ in passages]
    for x, y in lcs([k for _, _, k in keys], said):
        hits[keys[x][0]].append((keys[x][1], y))
    out: list[tuple[int, int] | None] = []
    for words, h in zip(passages, hits, strict=True):
        runs: list[list[tuple[int, int]]] = []
        for n, (i, b) in enumerate(h):
            if not n or (i - h[n - 1][0]) - (b - h[n - 1][1]) > STRAY:
                runs.append([])
            runs[-1].append((i, b))
        kept = [x for r in ([r for r in runs if len(r) >= 3] or runs) for x in r]
        if len(kept) < min(3, -(-len(words) // 2)) or not kept:
            out.append(None)
            continue
        (lo, first), (hi, last) = kept[0], kept[-1]
        while lo > 0 and first > 0 and words[lo - 1] and words[lo - 1] == said[first - 1]:
            lo, first = lo - 1, first - 1
        while hi + 1 < len(words) and last + 1 < len(said) and words[hi + 1] and words[hi + 1] == said[last + 1]:
            hi, last = hi + 1, last + 1
        out.append((lo, hi))
    return out


def _mapped(f, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row's lists; null where one of them is."""
    return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)


_RUNS = pa.list_(pa.struct([("side", pa.string()), ("at", pa.int64()), ("n", pa.int64())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])))
def unmatched_runs(source: pa.Array, shown: pa.Array) -> pa.Array:
    """Runs of words of either side that have no partner in order: `lost` ones of source, `doubled` ones of shown."""

    def runs(a: list, b: list) -> list[dict]:
        hits, out = lcs(a, b), []
        for side, have, size in (("lost", [i for i, _ in hits], len(a)), ("doubled", [j for _, j in hits], len(b))):
            for lo, hi in zip([-1, *have], [*have, size], strict=True):
                if hi - lo > 1:
                    out.append({"side": side, "at": lo + 1, "n": hi - lo - 1})
        return out

    return _mapped(runs, _RUNS, source, shown)


@F.arrow_udf(T.LongType())
def common_words(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of a longest common subsequence of words."""
    return _mapped(lcs_length, pa.int64(), a, b)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def carried_times(shown: pa.Array, heard: pa.Array, starts: pa.Array) -> pa.Array:
    """A time for each word of shown: the start of the equal word of heard that the global alignment sets beside it, else null."""

    rows = list(zip(*(c.to_pylist() for c in (shown, heard, starts)), strict=True))
    whole = [k for k, row in enumerate(rows) if not any(x is None for x in row)]
    out: list = [None] * len(rows)
    for k, hits in zip(whole, global_pairs_of([rows[k][:2] for k in whole]), strict=True):
        out[k] = [None] * len(rows[k][0])
        for i, j in hits:
            out[k][i] = rows[k][2][j]
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def ordered_times(times: pa.Array) -> pa.Array:
    """Of the times that aren't null those of a longest run that never falls."""
    return _mapped(longest_ordered, pa.list_(pa.float64()), times)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def filled_times(times: pa.Array, words: pa.Array) -> pa.Array:
    """Times for all words, from anchors and the words' sentence ends; null without an anchor."""
    return _mapped(fill, pa.list_(pa.float64()), times, words)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))
def recited_parts(said: pa.Array, passages: pa.Array) -> pa.Array:
    """For each passage, as an array of words, its first and last word that was said, or null."""
    part = lambda x: None if x is None else {"first": x[0], "last": x[1]}
    return _mapped(lambda a, p: [part(x) for x in recited(a, p)], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), said, passages)


def sequence_coverage(rows: DataFrame, keys: list[str], source: Column, shown: Column, fails: int = 2) -> DataFrame:
    """(keys, side, at, n, level): X24. Each run of words lost from `source` or doubled in `shown`, arrays of word keys, by its place
    in its side; runs of `fails` words or more fail, shorter ones warn. A row whose words are all there in order has none;
    a null array gives none either."""
    runs = rows.select(*keys, F.explode(unmatched_runs(source, shown)).alias("r"))
    return runs.select(*keys, "r.side", "r.at", "r.n", F.when(F.col("r.n") >= fails, "fail").otherwise("warn").alias("level"))


def heard_shares(rows: DataFrame, keys: list[str], text: Column, heard: Column) -> DataFrame:
    """(keys, said, extra): X42. The share of a text's words that were heard in order, and the words heard for each of the text's."""
    n = F.greatest(F.lit(1), F.size("_a")).cast("double")
    r = rows.select(*keys, text.alias("_a"), heard.alias("_b")).withColumn("_n", common_words("_a", "_b"))
    return r.select(*keys, (F.col("_n") / n).alias("said"), (F.size("_b") / n).alias("extra"))


def transferred_times(rows: DataFrame, keys: list[str], display: Column, shown: Column, sources: list[tuple[Column, Column]]) -> DataFrame:
    """(keys, anchors, times): X33, X34, W10. For each word of `display`, with keys `shown`, the time of the first source (keys and starts of
    heard words) that anchors it; anchors out of order are dropped, so that the longest run stays, and words between anchors get times of their own."""
    each = [carried_times(shown, words, starts).alias(f"_t{i}") for i, (words, starts) in enumerate(sources)]
    r = rows.select(*keys, display.alias("_d"), *each)
    first = F.transform(F.arrays_zip(*[f"_t{i}" for i in range(len(sources))]), lambda z: F.coalesce(*[z[f"_t{i}"] for i in range(len(sources))]))
    return r.withColumn("anchors", ordered_times(first)).select(*keys, "anchors", filled_times("anchors", "_d").alias("times"))
