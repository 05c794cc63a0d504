"""Who is quoted: collections and persons named near a quotation, quotations between an opener and an attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.text import latin_key, let, words
from quotary.operators.grams import gram_hashes


def _named(light: Column, collections: dict[str, str]) -> Column:
    """The collection whose name a word is; null for other words."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in collections.items() for x in kv]), light)


def named_collections(spans: DataFrame, rows: DataFrame, doc: str, collections: dict[str, str], reported: str, introduces: str, chain: str, sentence_end: str) -> DataFrame:
    """(doc, start, end, collection, side): J25. rows(doc, raw, light). The collection that a reporting word names in the six
    words after a span, two words at most before it; else the last one that a word of `introduces` names within the 30 words
    before, if a word of `chain` follows the name and no sentence ends in between."""
    j = spans.join(rows, doc)
    near = lambda c, lo, n: F.slice(c, F.greatest(lo, F.lit(0)).cast("int") + 1, F.greatest(n, F.lit(0)).cast("int"))
    after = near("light", F.col("end"), F.lit(6))
    told = F.array_position(F.transform(F.slice(after, 1, 3), lambda w: w.rlike(reported)), True)
    right = F.when(told > 0, _named(F.get(after, told.cast("int")), collections))
    lo = F.greatest(F.col("start") - 30, F.lit(0))
    before, raw = near("light", lo, F.col("start") - lo), near("raw", lo, F.col("start") - lo)

    def left(b: Column, r: Column) -> Column:
        at = F.array_max(F.transform(b, lambda w, i: F.when(w.rlike(introduces) & _named(F.get(b, i + 1), collections).isNotNull(), i)))
        rest = lambda a: F.slice(a, at + 2, F.size(a))
        return F.when(F.exists(rest(b), lambda w: w.rlike(chain)) & ~F.exists(rest(r), lambda w: w.rlike(sentence_end)), _named(F.get(b, at + 1), collections))

    both = j.withColumns({"_r": right, "_l": let(before, lambda b: let(raw, lambda r: left(b, r)))})
    return both.where("_r is not null or _l is not null").select(doc, "start", "end", F.coalesce("_r", "_l").alias("collection"), F.when(F.col("_r").isNotNull(), "after").otherwise("before").alias("side"))


def named_persons(spans: DataFrame, rows: DataFrame, doc: str, from_word: str, formula: tuple[str, ...], stop: tuple[str, ...], breaks: str, back: int = 60) -> DataFrame:
    """(doc, start, person): J26. The person named last in the `back` words before a span: one to five words between a word of
    `from_word` and the formula, of them the first telling one of three letters or more; none if a word of `breaks` follows."""
    j = spans.join(rows.select(doc, "light"), doc)
    lo = F.greatest(F.col("start") - back, F.lit(0))
    lead = F.slice("light", (lo + 1).cast("int"), (F.col("start") - lo).cast("int"))
    k = len(formula)

    def last(b: Column) -> Column:
        ends = lambda i: F.get(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda n: F.slice(b, i + n + 2, F.lit(k)) == F.array(*map(F.lit, formula))), F.lit(0))
        return F.array_max(F.transform(b, lambda w, i: F.when(w.rlike(from_word) & ends(i).isNotNull(), F.struct(i.alias("i"), ends(i).alias("n")))))

    def person(b: Column, m: Column) -> Column:
        name = F.filter(F.slice(b, m["i"] + 2, m["n"]), lambda w: ~w.isin(*stop) & (F.length(w) >= 3))
        rest = F.slice(b, m["i"] + m["n"] + k + 2, F.size(b))
        return F.when(~F.exists(rest, lambda w: w.rlike(breaks)), F.get(name, F.lit(0)))

    found = let(lead, lambda b: let(last(b), lambda m: F.when(m.isNotNull(), person(b, m))))
    return j.withColumn("person", found).where("person is not null").select(doc, "start", "person")


def attributed_quotes(rows: DataFrame, canon: DataFrame, doc: str, opener: str, reported: str, collections: dict[str, str], back: int = 40, least: int = 2, most: int = 40) -> DataFrame:
    """(doc, start, end, collection, passage): J27, T5. rows(doc, light), canon(collection, passage, words). What stands between
    an opener, `back` words back at most, and a reporting word that names a collection among the three words after it: `least` to
    `most` words that a passage of the collection has in that order; of those that have them the shortest passage.

    Quotations meet passages by their first two words; only these are compared whole."""
    n = F.size("light")
    told = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("light", i).rlike(reported))
    lo = lambda i: F.greatest(i - back, F.lit(0))
    near = lambda i: F.struct(i.alias("i"), F.slice("light", lo(i) + 1, i - lo(i)).alias("lead"), F.slice("light", i + 2, F.lit(3)).alias("ahead"))
    # a reporting word takes along the words around it, not the document's
    at = rows.where(n > 0).select(doc, F.explode(F.transform(told, near)).alias("m")).select(doc, "m.i", "m.lead", "m.ahead")
    at = at.withColumn("collection", F.get(F.array_compact(F.transform("ahead", lambda w: _named(w, collections))), F.lit(0))).where("collection is not null")
    from_ = F.array_max(F.transform("lead", lambda w, k: F.when(w.rlike(opener), k + 1)))
    q = at.withColumn("from", from_).where(F.col("from").isNotNull() & (F.size("lead") - F.col("from")).between(least, most))
    q = q.select(doc, (F.col("i") - F.size("lead") + F.col("from")).alias("start"), F.col("i").alias("end"), "collection", F.slice("lead", F.col("from") + 1, F.size("lead") - F.col("from")).alias("q"))
    q = q.select("*", F.get(gram_hashes(F.col("q"), 2), F.lit(0))["h"].alias("h"))
    c = canon.select("collection", "passage", "words", F.explode(F.array_distinct(F.transform(gram_hashes(F.col("words"), 2), lambda g: g["h"]))).alias("h"))
    flat = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    hit = q.join(c, ["collection", "h"]).where(F.contains(flat("words"), flat("q")))
    return hit.groupBy(doc, "start", "end", "collection").agg(F.min_by("passage", F.struct(F.size("words"), "passage")).alias("passage")).select(doc, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "collection", "passage")


def kept_references(refs: DataFrame, key: list[str], method: str, text: str, retired: str, least: int = 4) -> DataFrame:
    """refs without those of a retired method (P10) and those of which fewer than `least` words are left behind an attribution
    (P9); two are enough where the speaker attributes them aloud (`aloud`)."""
    n = F.size(words(F.col(text)))
    return refs.where((F.col(method) != retired) & ((n >= least) | (F.col("aloud") & (n >= 2))))


def summary(refs: DataFrame, key: list[str]) -> DataFrame:
    """(key, found, matched, by_scan): A19. Counts of a run's references."""
    return refs.groupBy(*key).agg(F.count(F.lit(1)).alias("found"), F.count_if("matched").alias("matched"), F.count_if(F.col("method") == "ngram").alias("by_scan"))


def light_rows(docs: DataFrame, doc: str, text: str, key=latin_key) -> DataFrame:
    """(doc, raw, light): a document's words and their keys."""
    return docs.select(doc, F.explode(F.array(words(F.col(text)))).alias("raw")).select(doc, "raw", F.explode(F.array(F.transform("raw", key))).alias("light"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
