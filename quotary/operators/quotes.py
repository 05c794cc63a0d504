"""Finding quotations of a canon inside documents: anchors, alignment, selection, extension, merging, walking, splitting.

A canon is (group, passage, text); passages are numbered within their group. Documents meet passages by hashed n-grams.
From there on all work is on small rows: one alignment for each diagonal of a document and a passage, over a window that
the passage's length bounds; a document's spans are settled by windows and folds over its own spans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.lang import ARABIC, Language, cites, in_plea_sentence, is_negation, keys
from quotary.functions.text import half_up, let, words
from quotary.operators.grams import gram_hashes, gram_join
from quotary.operators.spans import diagonal_islands
from quotary.sources.scratch import materialize

#: Words of an anchor, least words of a span that becomes a reference, words to either side of a passage's window.
ANCHOR, LEAST, BEFORE, AFTER = 4, 5, 4, 8
#: Scores of an alignment: equal words, different words, a word that one side lacks.
EQUAL, DIFFERENT, LACKING = 2, -2, -1
#: Rare words of a passage that a window must hold at most before it is read.
HELD = 3
#: Numbers that a filter of documents tells apart: its size, whatever the input.
FILTER = 1 << 20
PART = "struct<group:bigint,passage:bigint,start:bigint,end:bigint>"


def aligned(passage: list[int], window: list[int]) -> tuple[int, int, int]:
    """(first, end, matched): the words of window that the best local alignment matches; (-1, -1, 0) if none.

    A row of scores at a time: a gap along the row is a running maximum of score + column. Of equal cells the first in
    row order ends the alignment; on the way back a step along both sides goes before one along the passage.
    """
    n, m = len(passage), len(window)
    if not n or not m:
        return -1, -1, 0
    a, b, col = np.asarray(passage), np.asarray(window), np.arange(m + 1)
    score = np.zeros((n + 1, m + 1), np.int64)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(score[i - 1, :-1] + np.where(b == a[i - 1], EQUAL, DIFFERENT), score[i - 1, 1:] + LACKING)
        np.maximum(row, 0, out=row)
        score[i] = np.maximum.accumulate(row - LACKING * col) + LACKING * col
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    first = last = -1
    matched = 0
    while i and j and score[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (EQUAL if same else DIFFERENT):
            if same:
                matched, first, last = matched + 1, j - 1, last if last >= 0 else j - 1
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + LACKING:
            i -= 1
        else:
            j -= 1
    return first, last + 1, matched


def _alignments(diagonals: DataFrame, doc: str) -> DataFrame:
    """diagonals(doc, group, passage, d, lo, window, words) with a_start, a_end (in the document) and matched."""

    def run(batches):
        for batch in batches:
            got = [aligned(p, w) for p, w in zip(batch.column("words").to_pylist(), batch.column("window").to_pylist(), strict=True)]
            lo = batch.column("lo").to_pylist()
            start = [x + s if n else -1 for x, (s, _, n) in zip(lo, got, strict=True)]
            end = [x + e if n else -1 for x, (_, e, n) in zip(lo, got, strict=True)]
            out = [*(batch.column(c) for c in (doc, "group", "passage", "d")), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([x[2] for x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[doc, "group", "passage", "d", "a_start", "a_end", "matched"])

    kind = diagonals.schema[doc].dataType.simpleString()
    return diagonals.mapInArrow(run, f"{doc} {kind}, group long, passage long, d long, a_start long, a_end long, matched long")


def tolerant_run(want: Column, have: Column, at: Column, skip: Column | int = 0) -> Column:
    """Whether the words `want`, without the first `skip`, stand in `have` from word `at` on, misheard words allowed.

    One edit in a word of four letters or more is free; other near misses, of two edits, may be a quarter of the words, one
    at least; words further apart end it. At least half must be there in full. The first words are looked at before the rest."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    n = F.size(want) - skip
    at = at.cast("int")
    kinds = F.zip_with(
        F.slice(want, skip + 1, F.greatest(n, F.lit(0))), F.slice(have, F.greatest(at, F.lit(0)) + 1, F.greatest(n, F.lit(0))),
        lambda w, g: F.when(w == g, 0).when(F.levenshtein(w, g, 2) < 0, 2).when((F.levenshtein(w, g) == 1) & (F.greatest(F.length(w), F.length(g)) >= 4), 0).otherwise(1),
    )
    count = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda s, x: s + F.when(x.isNull() | (x == 2), 1 << 20).otherwise(x))  # noqa: E731  a word too far apart is beyond any bound
    fits = (n > 0) & (at >= 0) & (at + n <= F.size(have))
    begins = reduce(lambda c, k: c & ((n <= k) | F.coalesce(F.levenshtein(F.get(want, skip + k), F.get(have, at + k), 2) >= 0, F.lit(False))), range(4), fits)
    good = lambda wrong: (wrong <= F.greatest(F.lit(1), F.floor(n * 0.25))) & (n - wrong >= F.ceil(n / 2))
    return F.coalesce(begins & let(count(kinds), good), F.lit(False))


def edits(a: str, b: str, most: int) -> int:
    """The edits between two words, most + 1 if they are more. A common beginning needs none."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return 1 + min(edits(a[i + 1 :], b[i + 1 :], most - 1), edits(a[i + 1 :], b[i:], most - 1), edits(a[i:], b[i + 1 :], most - 1))


class Hearing:
    """`tolerant_run` over lists, for kernels; how alike two words are is kept for pairs that were met."""

    #: Pairs that are kept, of words up to so many letters.
    PAIRS, LETTERS = 200_000, 40

    def __init__(self) -> None:
        self.kinds: dict[tuple[str, str], int] = {}

    def kind(self, w: str | None, g: str | None) -> int:
        """0 where one is free to stand for the other, 1 for a near miss, far more for others."""
        if w is None or g is None:
            return 1
        if w == g:
            return 0
        got = self.kinds.get((w, g))
        if got is None:
            e, most = edits(w, g, 2), max(len(w), len(g))
            got = 1 << 20 if e > 2 else 0 if e == 1 and most >= 4 else 1
            if most <= self.LETTERS:
                if len(self.kinds) >= self.PAIRS:
                    self.kinds.clear()
                self.kinds[w, g] = got
        return got

    def stands(self, want: list, lo: int, hi: int, have: list, at: int) -> bool:
        """Whether words lo to hi of `want` stand in `have` from word `at` on."""
        n = hi - lo
        if n <= 0 or at < 0 or at + n > len(have):
            return False
        wrong, most = 0, min(max(1, n // 4), n // 2)
        for k in range(min(4, n)):
            w, g = want[lo + k], have[at + k]
            if w is None or g is None:
                return False
            if w != g:
                wrong += self.kind(w, g)
                if wrong >= 1 << 20:
                    return False
        if wrong > most:
            return False
        rest = want[lo + 4 : hi]
        if rest == have[at + 4 : at + n] and None not in rest:
            return True
        for k, w in enumerate(rest, at + 4):
            wrong += self.kind(w, have[k])
            if wrong > most:
                return False
        return True


def named(docs: DataFrame, by: DataFrame, doc: str) -> DataFrame:
    """docs that a row of `by` names. A filter of fixed size is asked where they are read, so that those and few others are shuffled."""
    bucket = F.pmod(F.xxhash64(doc), F.lit(FILTER)).alias("_b")
    some = by.select(doc).distinct()
    near = docs.select("*", bucket).join(F.broadcast(some.select(bucket).distinct()), "_b", "left_semi")
    return near.drop("_b").join(some, doc, "left_semi")


def word_rows(docs: DataFrame, doc: str, text: str, lang: Language) -> DataFrame:
    """(doc, raw, deep): a document's words and their keys, one row a document."""
    rows = docs.select(doc, F.explode(F.array(words(F.col(text)))).alias("raw"))
    return rows.select(doc, "raw", F.explode(F.array(F.transform("raw", lang.deep))).alias("deep"))


def canon_rows(canon: DataFrame, lang: Language) -> DataFrame:
    """(group, passage, words, spelled): a passage's keys, and those that keep its spelling."""
    split = lambda key: F.filter(F.split(key(F.array_join(words(F.col("text")), " ")), " "), lambda w: w != "")
    by_word = lang.name == "latin"
    make = lambda key: F.filter(keys(F.col("text"), key), lambda w: w != "") if by_word else split(key)
    return canon.select(F.col("group").cast("long").alias("group"), F.col("passage").cast("long").alias("passage"), make(lang.deep).alias("words"), make(lang.spelling).alias("spelled"))


def anchor_hits(rows: DataFrame, canon: DataFrame, doc: str) -> DataFrame:
    """(doc, group, passage, p, q, d): where ANCHOR words of a document stand in a passage."""
    flat = lambda df, key, col: df.select(*key, F.posexplode(gram_hashes(F.col(col), ANCHOR)).alias("pos", "g")).select(*key, F.col("pos").cast("long").alias("pos"), "g.h", "g.c")
    return gram_join(flat(rows, [doc], "deep"), flat(canon, ["group", "passage"], "words"), doc, ["group", "passage"], most_passages=1 << 30).withColumn("d", F.col("p") - F.col("q"))


def anchored_spans(hits: DataFrame, rows: DataFrame, canon: DataFrame, doc: str, lang: Language) -> DataFrame:
    """(doc, p, start, end, group, passage): X1's first part. For each anchor in a document the best span around it, of anchor_hits.

    The span is the aligned one if it matches an anchor's worth of words, else the exact stretch on the anchor's diagonal
    (X3). The longest wins; of equals (T7) the one whose spelling agrees with more of the words said, then the one whose
    next passage follows, then the first of the canon."""
    h = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    lanes = hits.select(doc, "group", "passage", "d").distinct().join(rows.select(doc, "deep"), doc).join(canon.select("group", "passage", "words"), ["group", "passage"])
    lo = F.greatest(F.lit(0).cast("long"), F.col("d") - BEFORE)
    hi = F.least(F.size("deep").cast("long"), F.col("d") + F.size("words") + AFTER)
    lanes = lanes.select(doc, "group", "passage", "d", lo.alias("lo"), h(F.slice("deep", (lo + 1).cast("int"), (hi - lo).cast("int"))).alias("window"), h("words").alias("words"))
    found = _alignments(lanes, doc)
    exact = diagonal_islands(hits.select(doc, "group", "passage", "p", "q"), [doc, "group", "passage"], ANCHOR).withColumn("d", F.col("w_start") - F.col("q_start"))
    each = hits.join(found, [doc, "group", "passage", "d"]).join(exact, [doc, "group", "passage", "d"]).where("p >= w_start and p + 4 <= w_end")
    good = F.col("matched") >= ANCHOR
    each = each.select(doc, "p", "group", "passage", F.when(good, F.col("a_start")).otherwise(F.col("w_start")).alias("s"), F.when(good, F.col("a_end")).otherwise(F.col("w_end")).alias("e"))
    longest = each.withColumn("_n", F.max(F.col("e") - F.col("s")).over(Window.partitionBy(doc, "p"))).where("e - s = _n").drop("_n")
    ties = F.count(F.lit(1)).over(Window.partitionBy(doc, "p"))
    longest = longest.withColumn("ties", ties)
    # what decides ties is read only where there are any
    tied = longest.where("ties > 1").join(rows, doc).join(canon, ["group", "passage"])
    nxt = canon.select(F.col("group").alias("_g"), (F.col("passage") - 1).alias("_p"), F.col("words").alias("_next"))
    tied = tied.join(nxt, (F.col("group") == F.col("_g")) & (F.col("passage") == F.col("_p")), "left")
    said = F.transform(F.slice("raw", (F.col("s") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int")), lang.spelling)
    agree = F.size(F.filter(said, lambda w: F.array_contains("spelled", w)))
    goes_on = F.col("_next").isNotNull() & tolerant_run(F.coalesce("_next", F.array().cast("array<string>")), F.col("deep"), F.col("e"))
    tied = tied.select(doc, "p", "group", "passage", "s", "e", agree.alias("agree"), goes_on.alias("on"))
    both = tied.unionByName(longest.where("ties = 1").select(doc, "p", "group", "passage", "s", "e", F.lit(0).alias("agree"), F.lit(False).alias("on")))
    order = Window.partitionBy(doc, "p").orderBy(F.col("agree").desc(), F.col("on").desc(), "group", "passage")
    best = both.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(doc, "p", F.least("s", "p").alias("start"), F.greatest("e", F.col("p") + ANCHOR).alias("end"), "group", "passage")


def advance(anchors: DataFrame, doc: str) -> DataFrame:
    """(doc, start, end, group, passage): X1. Anchors in order, each that begins past the span taken before it."""
    c = F.array_sort(F.collect_list(F.struct("p", "start", "end", "group", "passage")))
    none = F.array().cast(f"array<{PART}>")
    step = lambda s, x: F.when(x["p"] < s["to"], s).otherwise(F.struct(F.greatest(x["end"], x["p"] + 1).alias("to"), F.concat(s["out"], F.array(F.struct(x["group"].alias("group"), x["passage"].alias("passage"), x["start"].alias("start"), x["end"].alias("end")))).alias("out")))
    taken = F.aggregate("_c", F.struct(F.lit(0).cast("long").alias("to"), none.alias("out")), step, lambda s: s["out"])
    return anchors.groupBy(doc).agg(c.alias("_c")).select(doc, F.explode(taken).alias("t")).select(doc, "t.start", "t.end", "t.group", "t.passage")


def extend_starts(spans: DataFrame, rows: DataFrame, canon: DataFrame, doc: str, lang: Language) -> DataFrame:
    """Spans whose start moves back over the passage's own word before, twice at most: the same word but for a prefixed
    `and`, or one negation for another."""
    j = spans.join(rows, doc).join(canon.select("group", "passage", "words"), ["group", "passage"])
    bare = lambda w: F.regexp_replace(w, lang.and_prefix, "")
    k = F.array_position("words", F.get("deep", F.col("start").cast("int"))).cast("int") - 1

    def takes(back: int) -> Column:
        want, at = F.get("words", F.col("k") - back), (F.col("start") - back).cast("int")
        same = bare(want) == bare(F.get("deep", at))
        denied = want.rlike(lang.negation) & is_negation(F.get("raw", at), lang)
        return (F.col("k") >= back) & (F.col("start") >= back) & F.coalesce(same | denied, F.lit(False))

    j = j.withColumn("k", F.coalesce(k, F.lit(-1)))
    moved = F.when(takes(1) & takes(2), 2).when(takes(1), 1).otherwise(0)
    return j.select(doc, (F.col("start") - moved).alias("start"), "end", "group", "passage")


def merge_parts(spans: DataFrame, doc: str, gap: int = 0) -> DataFrame:
    """(doc, start, end, parts): W2, W3. Spans with parts(group, passage, start, end) in order; those that touch are one, and
    so are those at most `gap` apart whose first parts name one passage. A fold over a document's own spans."""
    one = F.struct("start", "end", "parts")
    none = F.array().cast(f"array<struct<start:bigint,end:bigint,parts:array<{PART}>>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        a, b = last["parts"][0], x["parts"][0]
        again = (a["group"] == b["group"]) & (a["passage"] == b["passage"]) & (x["start"] - last["end"] <= gap)
        joins = (F.size(acc) > 0) & ((x["start"] <= last["end"]) | again)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.concat(last["parts"], x["parts"]).alias("parts"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["parts"].alias("parts")))))

    merged = F.aggregate("_c", none, step)
    return spans.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("_c")).select(doc, F.explode(merged).alias("m")).select(doc, "m.start", "m.end", "m.parts")


def walk_on(spans: DataFrame, rows: DataFrame, canon: DataFrame, doc: str) -> DataFrame:
    """Spans carried on into the passages that follow one of their own, as long as the document does.

    A round takes every walk that still goes on one passage further: it meets that passage alone, however many its group has."""
    s = spans.withColumn("_id", F.struct("start", "end"))
    ways = s.select(doc, "_id", "end", F.explode(F.array_distinct(F.transform("parts", lambda p: F.struct(p["group"].alias("group"), p["passage"].alias("passage"))))).alias("c"))
    live = ways.select(doc, "_id", "c.group", "c.passage", F.col("c.passage").alias("at"), F.col("end").cast("long").alias("to"), F.array().cast(f"array<{PART}>").alias("out"))
    following, said = canon.select("group", (F.col("passage") - 1).alias("at"), "words"), rows.select(doc, "deep")
    gone = None
    while True:
        met = live.join(following, ["group", "at"]).join(said, doc).where(tolerant_run(F.col("words"), F.col("deep"), F.col("to")))
        part = F.struct(F.col("group"), (F.col("at") + 1).alias("passage"), F.col("to").alias("start"), (F.col("to") + F.size("words")).alias("end"))
        live = materialize(met.select(doc, "_id", "group", "passage", (F.col("at") + 1).alias("at"), (F.col("to") + F.size("words")).alias("to"), F.concat("out", F.array(part)).alias("out")), "walks")
        if live.isEmpty():
            break
        gone = live if gone is None else gone.unionByName(live)
    if gone is None:
        return s.select(doc, "start", "end", "parts")
    furthest = gone.groupBy(doc, "_id").agg(F.max_by(F.struct("to", "out"), F.struct("to", -F.col("group"), -F.col("passage"), "at")).alias("w"))
    j = s.join(furthest, [doc, "_id"], "left")
    return j.select(doc, "start", F.greatest("end", F.coalesce("w.to", "end")).alias("end"), F.concat("parts", F.coalesce("w.out", F.array().cast(f"array<{PART}>"))).alias("parts"))


def trim_opener(spans: DataFrame, lang: Language, most: int = 5) -> DataFrame:
    """A span that begins with the ritual opener, `most` words at most, begins with its next part."""
    if not lang.opener:
        return spans
    parts = F.array_sort("parts", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(0))
    s = spans.withColumn("_p", parts)
    first = F.get("_p", F.lit(0))
    hit = (F.size("_p") > 1) & (first["group"] == lang.opener[0]) & (first["passage"] == lang.opener[1]) & (first["end"] - first["start"] <= most) & (first["start"] == F.col("start"))
    rest = F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0)))
    return s.withColumns({"start": F.when(hit, F.get("_p", F.lit(1))["start"]).otherwise(F.col("start")), "parts": F.when(hit, rest).otherwise(F.col("parts"))}).drop("_p")


def _settled(hits: DataFrame, rows: DataFrame, canon: DataFrame, doc: str, lang: Language) -> DataFrame:
    anchors = materialize(anchored_spans(hits, rows, canon, doc, lang), "anchors")
    taken = materialize(extend_starts(advance(anchors, doc), rows, canon, doc, lang), "taken")
    one = taken.withColumn("parts", F.array(F.struct("group", "passage", F.col("start"), F.col("end")).cast(PART)))
    walked = materialize(walk_on(materialize(merge_parts(one, doc), "merged"), rows, canon, doc), "walked")
    return trim_opener(merge_parts(walked, doc, gap=2), lang)


def find_spans(docs: DataFrame, canon: DataFrame, doc: str, text: str, lang: Language = ARABIC) -> DataFrame:
    """(doc, start, end, group, passage, parts): X1 to X8. Every stretch of a document that quotes the canon.

    Word positions from 0, end exclusive. group and passage are those of the first part; parts are all passages that the
    stretch covers, with their places. A stretch that runs over a word that introduces a quotation, and which its passages
    lack, is cut there, and either side is read anew (X8). Documents without a quotation give no row; after the first
    reading only those with an anchor take part.
    """
    docs, known = docs.select(doc, text), materialize(canon_rows(canon, lang), "canon")
    hits = materialize(anchor_hits(word_rows(docs, doc, text, lang), known, doc), "hits")
    rows = materialize(word_rows(named(docs, hits, doc), doc, text, lang), "words")
    spans = materialize(_settled(hits, rows, known, doc, lang), "spans")
    # Cuts at citing words with two other words before them
    held = spans.select(doc, "start", F.explode(F.array_distinct(F.transform("parts", lambda p: F.struct(p["group"].alias("group"), p["passage"].alias("passage"))))).alias("c"))
    vocabulary = held.select(doc, "start", "c.group", "c.passage").join(known, ["group", "passage"]).groupBy(doc, "start").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("known"))
    j = spans.join(vocabulary, [doc, "start"]).join(rows, doc)
    inside = F.slice("raw", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    citing = F.filter(F.transform(inside, lambda w, i: F.when(cites(w, lang) & ~F.array_contains("known", lang.deep(w)), i)), lambda i: i.isNotNull())
    cuts = let(citing, lambda c: F.filter(c, lambda i: i - F.size(F.filter(c, lambda k: k < i)) >= 2))
    j = materialize(j.withColumn("cuts", F.transform(cuts, lambda i: i.cast("long"))).withColumn("raw", F.when(F.size("cuts") > 0, F.col("raw"))), "cuts")
    whole = j.where(F.size("cuts") == 0).select(doc, "start", "end", "parts")
    edges = F.concat(F.array(F.lit(-1).cast("long")), "cuts", F.array(F.col("end") - F.col("start")))
    pieces = j.where(F.size("cuts") > 0).select(doc, "start", "raw", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cuts") + 1), lambda k: F.struct((F.element_at(edges, k) + 1).alias("a"), F.element_at(edges, k + 1).alias("b")))).alias("piece", "x"))
    pieces = pieces.select(doc, (F.col("start") + F.col("x.a")).alias("off"), F.slice("raw", (F.col("start") + F.col("x.a") + 1).cast("int"), (F.col("x.b") - F.col("x.a")).cast("int")).alias("raw")).where(F.size("raw") >= ANCHOR)
    pieces = pieces.withColumn("_piece", F.concat_ws(":", F.col(doc).cast("string"), F.col("off").cast("string")))
    pieces = materialize(pieces.withColumn("deep", F.transform("raw", lang.deep)), "pieces")
    if pieces.isEmpty():
        return whole.select(doc, "start", "end", F.col("parts")[0]["group"].alias("group"), F.col("parts")[0]["passage"].alias("passage"), "parts")
    said = pieces.select("_piece", "raw", "deep")
    inner = _settled(materialize(anchor_hits(said, known, "_piece"), "hits"), said, known, "_piece", lang)
    back = inner.join(pieces.select("_piece", doc, "off"), "_piece")
    shift = lambda p: F.struct(p["group"].alias("group"), p["passage"].alias("passage"), (p["start"] + F.col("off")).alias("start"), (p["end"] + F.col("off")).alias("end"))
    again = back.select(doc, (F.col("start") + F.col("off")).alias("start"), (F.col("end") + F.col("off")).alias("end"), F.transform("parts", shift).alias("parts"))
    every = whole.unionByName(again)
    return every.select(doc, "start", "end", F.col("parts")[0]["group"].alias("group"), F.col("parts")[0]["passage"].alias("passage"), "parts")


def drop_borrowed(spans: DataFrame, docs: DataFrame, canon: DataFrame, doc: str, text: str, lang: Language = ARABIC, most: int = 6) -> DataFrame:
    """Spans without those that are the speaker's own words in the canon's phrases.

    A span stays if it has fewer than LEAST words or several passages, if a citing word stands in the 6 words before it, if
    it begins at most 3 words after another span, if it's the whole passage or stands at its start or end. Else it goes
    within a plea (P8) that isn't the passage's own, and, up to `most` words, if it has a word that the passage lacks or
    each of its known 4-grams stands in two passages or more."""
    spans, known = materialize(spans, "borrowed"), canon_rows(canon, lang)
    rows = word_rows(named(docs.select(doc, text), spans, doc), doc, text, lang)
    grams_in = known.select("group", "passage", F.explode(gram_hashes(F.col("words"), ANCHOR)).alias("g")).groupBy("g.h", "g.c").agg(F.count_distinct("group", "passage").alias("df"))
    before = F.lag("end").over(Window.partitionBy(doc).orderBy("start"))
    j = spans.withColumn("_before", before).join(rows, doc).join(known.select("group", "passage", "words"), ["group", "passage"])
    n, start = F.col("end") - F.col("start"), F.col("start").cast("int")
    lead = F.slice("raw", F.greatest(start - 6, F.lit(0)) + 1, F.least(start, F.lit(6)))
    said = F.slice("deep", start + 1, n.cast("int"))
    bare = lambda w: F.regexp_replace(w, lang.and_prefix, "")
    edge = (bare(F.get(said, F.lit(0))) == bare(F.get("words", F.lit(0)))) | (F.element_at(said, -1) == F.element_at("words", -1))
    cited = F.exists(lead, lambda w: cites(w, lang))
    keep = (n < LEAST) | (F.size(F.array_distinct(F.transform("parts", lambda p: F.struct(p["group"], p["passage"])))) > 1) | cited | F.coalesce(start - F.col("_before") <= 3, F.lit(False)) | (n >= F.size("words")) | edge
    plea = (F.exists(lead, lambda w: lang.light(w).rlike(lang.plea)) | in_plea_sentence(F.col("raw"), start, lang)) & ~lang.light(F.get("raw", start)).rlike(lang.plea_opener)
    stray = F.exists(said, lambda w: ~F.array_contains("words", w))
    j = j.select(*spans.columns, F.coalesce(keep, F.lit(False)).alias("_keep"), F.coalesce(plea, F.lit(False)).alias("_plea"), stray.alias("_stray"), said.alias("_said"))
    j = materialize(j, "judged")
    open_ = j.where(f"not _keep and not _plea and end - start <= {most} and not _stray")
    dfs = open_.select(doc, "start", F.explode(gram_hashes(F.col("_said"), ANCHOR)).alias("g")).select(doc, "start", "g.h", "g.c").join(grams_in, ["h", "c"])
    common = dfs.groupBy(doc, "start").agg(F.min("df").alias("least")).where("least >= 2").select(doc, "start", F.lit(True).alias("_common"))
    j = j.join(common, [doc, "start"], "left")
    out = F.col("_keep") | (~F.col("_plea") & ((n > most) | (~F.col("_stray") & F.col("_common").isNull())))
    return j.where(out).select(*spans.columns)


def refs_from_spans(spans: DataFrame, doc: str) -> DataFrame:
    """(doc, group, first, last, start, end): X12's runs. Parts of a span that follow each other, in number and without a
    space between, are one range (W18)."""
    p = spans.select(doc, F.col("start").alias("_span"), F.explode("parts").alias("p")).select(doc, "_span", "p.group", "p.passage", F.col("p.start").alias("s"), F.col("p.end").alias("e"))
    order = Window.partitionBy(doc, "_span").orderBy("s", "e")
    follows = (F.lag("group").over(order) == F.col("group")) & (F.lag("passage").over(order) + 1 == F.col("passage")) & (F.col("s") <= F.lag("e").over(order))
    runs = p.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(doc, "_span", "_run", "group").agg(F.min("passage").alias("first"), F.max("passage").alias("last"), F.min("s").alias("start"), F.max("e").alias("end")).drop("_span", "_run")


def widened_refs(existing: DataFrame, runs: DataFrame, doc: str, least: int = LEAST, confidence: float = 0.8) -> DataFrame:
    """(doc, group, first, last, start, end, confidence, method): X12, J7. existing(doc, group, passage, start, end,
    confidence, method) widened to the longest run of its group that holds its passage and is longer than it; and runs of
    `least` words or more that no existing one lies in, as new references."""
    e = existing.withColumn("_i", F.monotonically_increasing_id())
    inside = (F.col("r.group") == F.col("e.group")) & F.col("e.passage").between(F.col("r.first"), F.col("r.last")) & (F.col(f"e.{doc}") == F.col(f"r.{doc}"))
    pairs = e.alias("e").join(runs.alias("r"), inside)
    longer = pairs.where("r.end - r.start > e.end - e.start").groupBy("e._i").agg(F.max_by(F.struct("r.first", "r.last", "r.start", "r.end"), F.struct(F.col("r.end") - F.col("r.start"), -F.col("r.start"))).alias("w"))
    wide = e.join(longer, "_i", "left")
    old = wide.select(doc, "group", F.coalesce("w.first", "passage").alias("first"), F.coalesce("w.last", "passage").alias("last"), F.coalesce("w.start", "start").alias("start"), F.coalesce("w.end", "end").alias("end"), "confidence", "method")
    new = runs.alias("r").join(e.alias("e"), inside, "left_anti").where(F.col("end") - F.col("start") >= least)
    return old.unionByName(new.select(doc, "group", "first", "last", "start", "end", F.lit(confidence).alias("confidence"), F.lit("ngram").alias("method")))


def best_windows(docs: DataFrame, canon: DataFrame, doc: str, text: str, passage: str, canon_text: str, least: float = 0.65, shortest: int = 5, key=None) -> DataFrame:
    """(doc, passage, start, end, score): X9. Of every passage, `shortest` words or more, the window of its own length in the
    document whose distinct words are most alike by Jaccard, the first of equals, if `least` or more.

    A window that alike has `ceil(least * size)` of the passage's distinct words or more, so of any `size - ceil(least * size) + k`
    of them it holds k, HELD of them at most. The documents' rarest ones alone are joined, and only windows that hold so many
    are read. Overlaps of different passages are settled by overlaps_by_score."""
    from quotary.functions.text import latin_key

    key = key or latin_key
    rows = docs.select(doc, F.explode(F.array(F.filter(keys(F.col(text), key), lambda w: w != ""))).alias("w"))
    known = canon.select(passage, F.explode(F.array(F.filter(keys(F.col(canon_text), key), lambda w: w != ""))).alias("a")).where(F.size("a") >= shortest).withColumn("set", F.array_distinct("a"))
    at = rows.select(doc, F.size("w").alias("total"), F.posexplode("w").alias("pos", "word"))
    said = at.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = known.select(passage, F.size("a").alias("n"), F.size("set").alias("m"), F.explode("set").alias("word")).join(said, "word", "left")
    enough = F.ceil(F.col("m") * least)
    ranked = ranked.withColumn("k", F.least(enough, F.lit(HELD)).cast("int")).withColumn("_r", F.row_number().over(Window.partitionBy(passage).orderBy(F.coalesce("df", F.lit(0)), "word"))).where(F.col("_r") <= F.col("m") - enough + F.col("k"))
    ranked = materialize(ranked.select(passage, "n", "k", "word"), "ranked")
    near = at.join(ranked, "word").where("n <= total").groupBy(doc, passage, "n", "k", "total").agg(F.array_sort(F.collect_list("pos")).alias("p"))

    def windows(i: Column) -> Column:
        """Where a window may begin that holds the i-th place and the k - 1 after it."""
        first, last = F.get("p", i), F.get("p", i + F.col("k") - 1)
        lo, hi = F.greatest(last - F.col("n") + 1, F.lit(0)), F.least(first, F.col("total") - F.col("n"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("k")), windows))))
    held = near.where("size(p) >= k").select(doc, passage, starts.alias("starts")).where("size(starts) > 0")
    lists = held.join(rows, doc).join(known, passage)
    scored = F.transform("starts", lambda i: F.struct(_alike(F.array_distinct(F.slice("w", i + 1, F.size("a"))), F.col("set")).alias("score"), (-i).alias("i")))
    best = lists.select(doc, passage, F.size("a").alias("n"), F.array_max(scored).alias("b"))
    return best.where(F.col("b.score") >= least).select(doc, passage, (-F.col("b.i")).cast("long").alias("start"), (F.col("n") - F.col("b.i")).cast("long").alias("end"), half_up(F.col("b.score")).alias("score"))


def _alike(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def overlaps_by_score(spans: DataFrame, doc: str, order: list[str], score: str, carry: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(doc, start, end, score, carry): W4. Spans in order of position; one that begins inside the span kept last takes its
    place if its score is higher, else goes. A fold over a document's own spans."""
    one = F.struct(start, *order, end, score, *[c for c in carry if c not in order])

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        inside = (F.size(acc) > 0) & (x[start] < last[end])
        return F.when(~inside, F.concat(acc, F.array(x))).when(x[score] > last[score], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)

    listed = spans.groupBy(doc).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    kept = F.aggregate("_c", F.filter("_c", lambda x: F.lit(False)), step)
    return listed.select(doc, F.explode(kept).alias("k")).select(doc, *[f"k.{c}" for c in dict.fromkeys([start, end, score, *carry])])
