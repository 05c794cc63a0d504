"""References: best matches, cross-checks, dedupe, location and classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.text import half_up, latin_key, words
from quotary.sources.scratch import materialize


def word_sets(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, w): the distinct word keys of each row that has any, as hashes of 64 bits."""
    w = F.array_distinct(F.transform(F.filter(F.transform(words(F.col(text)), latin_key), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return df.select(*keys, F.explode(F.array(w)).alias("w")).where(F.size("w") > 0)


def known_words(a: DataFrame, b: DataFrame, keys: list[str], passage: str) -> DataFrame:
    """(keys, n, k): of a(keys, w) the number of distinct words and those that any of b(passage, w) has, with the number of passages that have
    them, the rarest first. Texts without such a word have no row. Written as a table, as texts are read and their words made only here."""
    df = b.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    known = a.select(*keys, F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word")
    return materialize(known.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("k")), "known")


def alike_known(known: DataFrame, b: DataFrame, keys: list[str], passage: str, least: float, contained: bool = True) -> DataFrame:
    """alike_pairs of known_words(keys, n, k) and b(passage, w). Passages too small to hold enough of a text's words, and texts with fewer
    known words than a passage has, don't meet. Shared words are counted in a node of their own, once a pair."""
    posting = b.select(passage, F.size("w").alias("m"), F.explode("w").alias("word"))
    spare = F.size("k") - F.ceil(F.col("n") * least) + 1
    prefix = known.where(spare > 0).select(*keys, "n", F.explode(F.slice("k", F.lit(1), spare.cast("int"))).alias("x")).select(*keys, "n", F.col("x.word").alias("word"))
    pairs = prefix.join(posting, "word").where(F.col("m") >= least * F.col("n")).select(*keys, passage)
    if contained:
        df = posting.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        rarest = posting.join(df, "word").groupBy(passage, "m").agg(F.min(F.struct("df", "word")).alias("x")).select(passage, "m", F.col("x.word").alias("word"))
        every = known.select(*keys, F.size("k").alias("_k"), F.explode("k").alias("x")).select(*keys, "_k", F.col("x.word").alias("word"))
        pairs = pairs.unionByName(every.join(rarest, "word").where("_k >= m").select(*keys, passage))
    sets = pairs.repartition(*keys).distinct().join(known, keys).join(b.select(passage, F.col("w").alias("set")), passage)
    s = F.size(F.array_intersect(F.col("k")["word"], F.col("set")))
    shared = sets.select(*keys, passage, "n", F.size("set").alias("m"), F.explode(F.array(s)).alias("s")).select(*keys, passage, "s", "n", "m")
    return shared.where((F.col("s") >= least * F.col("n")) | (F.lit(contained) & (F.col("s") == F.col("m"))))


def alike_pairs(texts: DataFrame, keys: list[str], text: str, canon: DataFrame, passage: str, canon_text: str, least: float, contained: bool = True) -> DataFrame:
    """(keys, passage, s, n, m): shared distinct words and both sizes of the pairs that share `least` of the text's distinct
    words or more, or, if `contained`, of which the text has all of the passage's.

    Of a text's n words such a partner misses few, so it has one of any n - ceil(least * n) + 1 of them. Words that no
    passage has go first there, then those of the fewest passages: a text with too few known words meets nothing, and
    words that many passages have are left out. A contained passage is met by its rarest word. No word's texts are paired
    with all of its passages unless it's among the rarest of both.
    """
    b = word_sets(canon, [passage], canon_text)
    return alike_known(known_words(word_sets(texts, keys, text), b, keys, passage), b, keys, passage, least, contained)


def best_match(texts: DataFrame, keys: list[str], text: str, canon: DataFrame, passage: str, canon_text: str, floor: float = 0.4, majority: float = 0.75) -> DataFrame:
    """(keys, passage, score): J3, T3. The Jaccard similarity of distinct words; 0.8 at least where one side holds all of the
    other's, 0.7 at least where a majority of three words or more of the text's is there. The first of equals; scores under the
    floor give no row."""
    o = alike_pairs(texts, keys, text, canon, passage, canon_text, floor)
    jaccard = F.col("s") / (F.col("n") + F.col("m") - F.col("s"))
    whole = (F.col("s") == F.col("n")) | (F.col("s") == F.col("m"))
    raw = F.when(whole, F.greatest(jaccard, F.lit(0.8))).when((F.col("n") >= 3) & (F.col("s") >= majority * F.col("n")), F.greatest(jaccard, F.lit(0.7))).otherwise(jaccard)
    order = Window.partitionBy(*keys).orderBy(F.col("raw").desc(), passage)
    return o.withColumn("raw", raw).where(F.col("raw") >= floor).withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, passage, half_up(F.col("raw")).alias("score"))


#: Asides of the speaker, up to four words after the word that opens them, and bracketed ones.
ASIDES = r"\s+(?:أي|يعني)\s+\S+(?:\s+\S+){0,3}|\([^)]*\)"


def best_body(texts: DataFrame, keys: list[str], text: str, canon: DataFrame, passage: str, canon_text: str, short: int = 6, asides: str = ASIDES) -> DataFrame:
    """(keys, passage, score): J4. Asides are left out. Of a text under `short` words all must be in the passage, and the score is
    their share of the passage's words, 0.08 or more. Of a longer one the score is Jaccard's, 0.8 at least if one holds
    the other word for word, 0.65 at least for a majority of 0.75; 0.5 or more. The first of equals."""
    key_list = lambda t: F.filter(F.transform(words(t), latin_key), lambda x: x != "")
    said = lambda df: df.select(*keys, F.explode(F.array(key_list(F.regexp_replace(F.col(text), asides, " ")))).alias("_w")).where(F.size("_w") > 0)
    c = canon.select(passage, F.explode(F.array(key_list(F.col(canon_text)))).alias("_a")).where(F.size("_a") > 0)
    hashed = lambda col: F.explode(F.array(F.array_distinct(F.transform(col, lambda x: F.xxhash64(x))))).alias("w")
    a, b = said(texts).select(*keys, hashed("_w")), c.select(passage, hashed("_a"))
    # word for word only those that are alike are compared: few texts, read again
    alike = materialize(alike_known(known_words(a, b, keys, passage), b, keys, passage, 0.5), "alike")
    o = alike.join(said(texts.join(alike.select(*keys).distinct(), keys, "left_semi")), keys).join(c, passage)
    joined = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    hits = F.size(F.filter("_w", lambda w: F.array_contains("_a", w)))
    holds = F.contains(joined("_w"), joined("_a")) | F.contains(joined("_a"), joined("_w"))
    o = o.select(*keys, passage, "s", "n", "m", F.size("_w").alias("_nw"), F.size("_a").alias("_na"), F.explode(F.array(F.struct(hits.alias("hits"), holds.alias("holds")))).alias("x"))
    jaccard = F.col("s") / (F.col("n") + F.col("m") - F.col("s"))
    longer = F.when(F.col("x.holds"), F.greatest(jaccard, F.lit(0.8))).when(F.col("x.hits") >= 0.75 * F.col("_nw"), F.greatest(jaccard, F.lit(0.65))).otherwise(jaccard)
    few = F.col("_nw") < short
    raw = F.when(few, F.when(F.col("s") == F.col("n"), F.col("_nw") / F.col("_na"))).otherwise(longer)
    good = o.withColumn("raw", raw).where(F.col("raw") >= F.when(few, 0.08).otherwise(0.5))
    order = Window.partitionBy(*keys).orderBy(F.col("raw").desc(), passage)
    return good.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, passage, half_up(F.col("raw")).alias("score"))


def like_any(texts: DataFrame, keys: list[str], text: str, canon: DataFrame, passage: str, canon_text: str, alike: float, inside: float, known: float) -> DataFrame:
    """(keys, formula, part, joined): P5, P6. Texts that are one of the given ones by Jaccard, lie in one by their share, or of
    whose words a share of `known` stands in all of them together."""
    b = word_sets(canon, [passage], canon_text)
    words_known = known_words(word_sets(texts, keys, text), b, keys, passage)
    o = alike_known(words_known, b, keys, passage, min(alike, inside), contained=False)
    formula = F.col("s") / (F.col("n") + F.col("m") - F.col("s")) >= alike
    one = o.groupBy(*keys).agg(F.bool_or(formula).alias("formula"), F.bool_or(F.col("s") >= inside * F.col("n")).alias("part"))
    joined = words_known.where(F.size("k") >= known * F.col("n")).select(*keys, F.lit(True).alias("joined"))
    both = one.join(joined, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("formula", "part", "joined")]).where("formula or part or joined")


def cross_check(claims: DataFrame, matches: DataFrame, keys: list[str], claimed: str, matched: str, score: str) -> DataFrame:
    """(keys, claimed, matched, chosen, confidence, verdict): J5, J6. Where a claim and the best match name one passage, 0.95
    at least; a claim alone 0.85 and stays as it is; a match alone its own score; where they differ the claim stays at 0.75,
    unless the match's score is 0.95 or more: then it's chosen."""
    j = claims.select(*keys, claimed).join(matches.select(*keys, matched, score), keys, "full_outer")
    alone, lost, same = F.col(matched).isNull(), F.col(claimed).isNull(), F.col(matched) == F.col(claimed)
    sure = F.col(score) >= 0.95
    return j.select(
        *keys, claimed, matched,
        F.when(lost | (~same & sure), F.col(matched)).otherwise(F.col(claimed)).alias("chosen"),
        F.when(alone, 0.85).when(lost, F.col(score)).when(same, F.greatest(F.lit(0.95), score)).otherwise(0.75).alias("confidence"),
        F.when(alone, "claim only").when(lost, "match only").when(same, "agree").otherwise("disagree").alias("verdict"),
    )


def settled_claims(rows: DataFrame, canon: DataFrame, key: list[str], said: str, score: str, *, sure: float = 0.95, alone: float = 0.85, doubted: float = 0.75, ahead: float = 0.15, lead: int = 3) -> DataFrame:
    """(key, group, passage, confidence, verdict, used): J5, J6. rows(key, said: word keys, claimed and matched: struct<group, passage> or null, `score` of the match);
    canon(group, passage, words: keys).

    Where claim and match differ the words said decide. Of neighbouring passages of a group the match is used if more of the first `lead` words are in it, as
    the label names the passage in which the words begin; of others if it has a share of all words more than `ahead` above the claim's.
    Else the claim is used. Both: `sure` at least; a claim alone: `alone`; a difference: `doubted`; a match alone: its own score. Rows with neither have no passage,
    0 and `no match`. A passage that the canon lacks has none of the words."""
    words_of = lambda side: canon.select(F.struct("group", "passage").alias(side), F.array_distinct("words").alias(f"_{side}"))
    r = rows.join(words_of("claimed"), "claimed", "left").join(words_of("matched"), "matched", "left")
    none = F.array().cast("array<string>")
    first = F.slice(said, 1, lead)
    within = lambda ws, side: F.size(F.filter(ws, lambda w: F.array_contains(F.coalesce(f"_{side}", none), w)))
    share = lambda side: within(F.col(said), side) / F.greatest(F.size(said), F.lit(1))
    c, m = F.col("claimed"), F.col("matched")
    both = c.isNotNull() & m.isNotNull()
    differ = both & ((c["group"] != m["group"]) | (c["passage"] != m["passage"]))
    beside = (c["group"] == m["group"]) & (F.abs(c["passage"] - m["passage"]) == 1)
    better = differ & F.when(beside, within(first, "matched") > within(first, "claimed")).otherwise(share("matched") > share("claimed") + ahead)
    used = F.when(c.isNotNull() & ~better, "claim").when(m.isNotNull(), "match").otherwise("none")
    chosen = F.when(used == "claim", c).otherwise(m)
    verdict = F.when(differ, "differ").when(both, "agree").when(c.isNotNull(), "claim only").when(m.isNotNull(), "match only").otherwise("no match")
    how_sure = F.when(differ, doubted).when(both, F.greatest(F.lit(sure), F.col(score))).when(c.isNotNull(), alone).when(m.isNotNull(), F.col(score)).otherwise(0.0)
    return r.select(*key, chosen["group"].alias("group"), chosen["passage"].alias("passage"), half_up(how_sure).alias("confidence"), verdict.alias("verdict"), used.alias("used"))


#: Words of 64 bits of the filter that runs of characters pass before they are shuffled: 32 MB in a task and on the driver, whatever the rows.
FILTER_WORDS = 1 << 22
#: Runs of a text of which the rarest meets other texts.
PICKS = 4
_BASE = 0x9E3779B97F4A7C15


def _run_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, Callable[[int], np.ndarray]]]:
    """(index of the first text, sizes, hashes): of stretches of some MB of texts; hashes(n) are those of the n bytes from each byte on."""
    at = 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= 1 << 20:
            held, to = held + len(texts[to]), to + 1
        x = np.frombuffer(b"".join(texts[at:to]), np.uint8).astype(np.uint64) + np.uint64(1)
        power = lambda base, size: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power(_BASE, len(x)))])
        back = power(pow(_BASE, -1, 1 << 64), len(x))

        def hashes(n: int, sums=sums, back=back) -> np.ndarray:
            h = (sums[n:] - sums[: len(sums) - n]) * back[: len(sums) - n] + np.uint64(n)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            return h ^ (h >> np.uint64(33))

        yield at, np.array([len(t) for t in texts[at:to]]), hashes
        at = to


def _runs(texts: DataFrame, per_stretch: Callable[[np.ndarray, Callable[[int], np.ndarray]], list[tuple[np.ndarray, int, np.ndarray]]]) -> DataFrame:
    """(_id, _n, _h) of texts(_id, _t): what per_stretch(sizes, hashes) finds, as (places of texts, n, hashes)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("_id")
            for first, sizes, hashes in _run_hashes([t.encode() for t in batch.column("_t").to_pylist()]):
                for owner, n, h in per_stretch(sizes, hashes):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + first, pa.int64())), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], names=["_id", "_n", "_h"])

    return texts.select("_id", "_t").mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, _n int, _h long")


def contained(df: DataFrame, key: str, text: str, seed: int = 12) -> DataFrame:
    """(key, held_by): J23. Pairs of different texts of which one stands in the other, wherever it begins and however short it is.

    A text of `seed` bytes or more meets others by the rarest of some runs of its bytes, `seed`, twice or four times as long; a shorter one
    by itself. Texts offer runs of just the lengths that are asked for, and only those that pass a filter of all that is asked for are shuffled.
    Runs that one text alone has meet no one. Null and empty texts stand in none. Keys name rows; rows of equal texts are taken together
    before they meet."""
    one = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t <> ''")
    texts = materialize(one.groupBy("_t").agg(F.min("_k").alias("_id")), "texts")

    def asked(sizes: np.ndarray, hashes: Callable[[int], np.ndarray]) -> list[tuple[np.ndarray, int, np.ndarray]]:
        n_of = np.select([sizes >= 4 * seed, sizes >= 2 * seed, sizes >= seed], [4 * seed, 2 * seed, seed], sizes)
        starts, out = np.cumsum(sizes) - sizes, []
        for n in np.unique(n_of):
            h, some = hashes(int(n)), np.flatnonzero(n_of == n)
            least = [np.unique(h[starts[i] : starts[i] + sizes[i] - n + 1])[:PICKS] for i in some]
            out.append((np.repeat(some, [len(x) for x in least]), int(n), np.concatenate(least)))
        return out

    asks = materialize(_runs(texts, asked), "asked")
    lengths = sorted(r["_n"] for r in asks.select("_n").distinct().collect())  # `seed` + 2 at most
    word = F.shiftrightunsigned("_h", 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    marks = asks.groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(_h & 63 as int)))").alias("b")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[marks.column("w").to_numpy()] = marks.column("b").to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def offered(sizes: np.ndarray, hashes: Callable[[int], np.ndarray]) -> list[tuple[np.ndarray, int, np.ndarray]]:
        ends, owner, out = np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(sizes)), sizes), []
        for n in (n for n in lengths if n <= len(ends)):
            h = hashes(n)
            hit = (shared.value[(h >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1)
            at = np.flatnonzero((hit > 0) & (np.arange(len(h)) + n <= ends[: len(h)]))
            o, g = owner[at], h[at]
            order = np.lexsort((g, o))
            o, g = o[order], g[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (g[1:] != g[:-1])
            out.append((o[new], n, g[new]))
        return out

    runs = materialize(_runs(texts, offered), "offered")
    common = runs.groupBy("_n", "_h").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    rarest = asks.join(common, ["_n", "_h"], "left").groupBy("_id", "_n").agg(F.min(F.struct(F.coalesce("_df", F.lit(1)).alias("d"), F.col("_h").alias("h"))).alias("_m")).where("_m.d > 1")
    met = rarest.select(F.col("_id").alias("_a"), "_n", F.col("_m.h").alias("_h")).join(runs.select(F.col("_id").alias("_b"), "_n", "_h"), ["_n", "_h"]).where("_a <> _b").select("_a", "_b")
    whole = lambda side: texts.select(F.col("_id").alias(f"_{side}"), F.col("_t").alias(f"_t{side}"))
    sure = met.join(whole("a"), "_a").join(whole("b"), "_b").where(F.contains("_tb", F.col("_ta"))).select("_a", "_b")
    return sure.select(F.col("_a").alias(key), F.col("_b").alias("held_by"))


def drop_contained(df: DataFrame, key: str, text: str, rank: str) -> DataFrame:
    """Texts that stand in another one go; of equal texts the first by rank and key stays. Null and empty texts stay."""
    order = Window.partitionBy(text).orderBy(rank, key)
    first = df.where(F.col(text) != "").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    kept = first.join(contained(first, key, text).select(key).distinct(), key, "left_anti")
    return kept.unionByName(df.where(F.col(text).isNull() | (F.col(text) == "")))


def deduplicated(refs: DataFrame, doc: str, order: str, text: str, *, method: str, retired: str, formulas: DataFrame, passage: str, formula: str, content: Column, aloud: Column, alike: float = 0.55, least: int = 4) -> DataFrame:
    """Refs without those of a retired method, then without those that are one of the `formulas`(passage, formula) by Jaccard, then
    without those of fewer than `least` words of content (two are enough where `aloud`), then without those that stand in one
    kept before in their document or hold one. Of what holds each other the first by order stays; null texts go as they have no content.
    A document's references of some hundred words are compared with one another; there are no pairs across documents."""
    live = refs.withColumns({"_c": F.size(words(content)), "_aloud": F.coalesce(aloud, F.lit(False))}).where(F.col(text).isNotNull() & (F.col(method) != retired))
    ritual = like_any(live, [doc, order], text, formulas, passage, formula, alike, 2.0, 2.0).select(doc, order)
    good = live.join(ritual, [doc, order], "left_anti").where((F.col("_c") >= least) | (F.col("_aloud") & (F.col("_c") >= 2)))
    listed = good.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    fits = lambda kept, x: ~F.exists(kept, lambda k: F.contains(k["t"], x["t"]) | F.contains(x["t"], k["t"]))
    fold = F.aggregate("_l", F.slice("_l", 1, 0), lambda kept, x: F.when(fits(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    chosen = listed.select(doc, F.explode(fold).alias("k")).select(doc, F.col("k.o").alias(order))
    return good.drop("_c", "_aloud").join(chosen, [doc, order], "left_semi")


def locate_unique(docs: DataFrame, doc: str, text: str, canon: DataFrame, passage: str, canon_text: str, first: int = 5, back: int = 0) -> DataFrame:
    """(doc, passage, pos, n): J10. The shortest prefix of a passage, `first` words or more (all of a shorter passage of three),
    that stands exactly once in a document.

    Documents are read once for the places of all prefixes, by their hash. A prefix with one place stands once; only where it has more
    the passage is compared, as far as it runs in common, with the words at its places: the prefix of n words stands once when one
    place only runs n words or more. With `back`, passages not found so are tried from their second to their `back + 1`st word, by
    `first` words; their place is that of their first word."""
    from quotary.operators.grams import gram_hashes

    keyed = lambda df, key, t, name: df.select(*key, F.explode(F.array(F.transform(words(F.col(t)), latin_key))).alias(name))
    known = keyed(canon, [passage], canon_text, "a").where(F.size("a") >= 3)
    rows = keyed(docs, [doc], text, "w")

    def places(n: int) -> DataFrame:
        """(doc, passage, k, pos, size): where the n words of a passage from k on stand, and how many words it has from there."""
        some = known.where(F.size("a") >= n if n == first else F.size("a") == n)
        want = some.select(passage, F.size("a").alias("m"), F.posexplode(F.slice(gram_hashes(F.slice("a", 1, n + back), n), 1, back + 1)).alias("k", "g"))
        want = want.select(passage, "k", (F.col("m") - F.col("k")).alias("size"), "g.h", "g.c")
        at = rows.where(F.size("w") >= n).select(doc, F.posexplode(gram_hashes(F.col("w"), n)).alias("pos", "g")).select(doc, "pos", "g.h", "g.c")
        return at.join(want, ["h", "c"]).select(doc, passage, "k", "pos", "size")

    met = materialize(reduce(DataFrame.unionByName, [places(n) for n in range(3, first + 1)]), "places")
    counted = met.groupBy(doc, passage, "k").agg(F.count(F.lit(1)).alias("_n"), F.min("pos").alias("pos"), F.min("size").alias("size"))
    least = F.least(F.lit(first), F.col("size"))
    single = counted.where("_n = 1").select(doc, passage, "k", "pos", least.alias("n"))

    # a document's words are cut at its places while they are one array of its row, and never copied for each of them
    again = met.where("k = 0").join(counted.where("k = 0 and _n > 1").select(doc, passage), [doc, passage], "left_semi")
    cuts = again.groupBy(doc, "pos").agg(F.max("size").alias("size")).groupBy(doc).agg(F.collect_list(F.struct("pos", "size")).alias("_cuts"))
    read = keyed(docs.select(doc, text).join(cuts, doc), [doc, "_cuts"], text, "w")
    said = read.select(doc, F.explode(F.transform("_cuts", lambda x: F.struct(x["pos"].alias("pos"), F.slice("w", x["pos"] + 1, x["size"]).alias("said")))).alias("x")).select(doc, "x.pos", "x.said")
    differs = F.array_position(F.zip_with("a", F.slice("said", F.lit(1), F.size("a")), lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    runs = again.join(said, [doc, "pos"]).join(known, passage).select(doc, passage, "pos", "size", F.when(differs > 0, differs - 1).otherwise(F.size("a")).alias("run"))
    order = Window.partitionBy(doc, passage).orderBy(F.col("run").desc(), "pos")
    top = runs.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("run").over(order)).where("_r = 1")
    longest = top.select(doc, passage, F.lit(0).alias("k"), "pos", F.greatest(F.col("_next") + 1, least).alias("n"), "run").where("run >= n").drop("run")
    best = single.unionByName(longest).groupBy(doc, passage).agg(F.min(F.struct("k", "pos", "n")).alias("b"))
    return best.select(doc, passage, F.greatest(F.col("b.pos") - F.col("b.k"), F.lit(0)).cast("long").alias("pos"), F.col("b.n").cast("long").alias("n"))


def locate_openings(docs: DataFrame, doc: str, text: str, canon: DataFrame, passage: str, canon_text: str, past: float = 0.25, fewest: int = 3, most: int = 6) -> DataFrame:
    """(doc, passage, n, pos): J11. The longest of a passage's first `most` to `fewest` words that stands in a document past a share of its words,
    and the first place of it there.

    Every longer opening begins with the shortest: documents are read once for its places, by their hash, and those that have one again for
    how far the passage's words run on there. A document's words are cut at its places while they are one array of its row."""
    from quotary.operators.grams import gram_hashes

    keyed = lambda df, key, t, name: df.select(*key, F.explode(F.array(F.transform(words(F.col(t)), latin_key))).alias(name)).where(F.size(name) >= fewest)
    known = keyed(canon, [passage], canon_text, "a").select(passage, F.slice("a", 1, most).alias("a"))
    want = known.select(passage, "a", F.get(gram_hashes(F.slice("a", 1, fewest), fewest), F.lit(0)).alias("g")).select(passage, "a", "g.h", "g.c")
    at = keyed(docs, [doc], text, "w").select(doc, F.size("w").alias("total"), F.posexplode(gram_hashes(F.col("w"), fewest)).alias("pos", "g")).where(F.col("pos") > past * F.col("total"))
    met = at.select(doc, "pos", "g.h", "g.c").join(want.select(passage, "h", "c"), ["h", "c"]).select(doc, passage, "pos")
    met = materialize(met, "openings")
    cuts = met.select(doc, "pos").distinct().groupBy(doc).agg(F.collect_list("pos").alias("_cuts"))
    again = keyed(docs.select(doc, text).join(cuts, doc), [doc, "_cuts"], text, "w")
    said = again.select(doc, F.explode(F.transform("_cuts", lambda x: F.struct(x.alias("pos"), F.slice("w", x + 1, F.lit(most)).alias("said")))).alias("x")).select(doc, "x.pos", "x.said")
    differs = F.array_position(F.zip_with("a", F.slice("said", F.lit(1), F.size("a")), lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    runs = met.join(said, [doc, "pos"]).join(known, passage).select(doc, passage, "pos", F.size("a").alias("_size"), F.explode(F.array(differs)).alias("_d"))
    run = runs.select(doc, passage, "pos", F.when(F.col("_d") > 0, F.col("_d") - 1).otherwise(F.col("_size")).cast("int").alias("n")).where(F.col("n") >= fewest)
    best = run.groupBy(doc, passage).agg(F.min(F.struct((-F.col("n")).alias("m"), "pos")).alias("b"))
    return best.select(doc, passage, (-F.col("b.m")).cast("long").alias("n"), F.col("b.pos").cast("long").alias("pos"))


def classify_inline(spans: DataFrame, chunk: DataFrame, doc: str, size: int, least: float = 0.5) -> DataFrame:
    """Spans with the chunks of `size` words that they overlap; a share of `least` inside a chunk makes the span part
    of it. The chunks that a span touches are known from its places: an equi-join on their numbers."""
    last = F.floor((F.col("w_end") - 1) / size)
    touched = spans.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("w_start") / size), last)))
    over = touched.join(chunk, [doc, "chunk_idx"])
    share = half_up((F.least("w_end", "c_end") - F.greatest("w_start", "c_start")) / (F.col("w_end") - F.col("w_start")))
    return over.withColumn("share", share).withColumn("inline", F.col("share") >= least)
