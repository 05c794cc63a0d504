"""Queries of the quotation finder, of references and labels, of assembled blocks and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.functions.lang import LATIN, cites, in_plea_sentence, is_negation, keys, splits_phrase
from quotary.operators import assembly as A
from quotary.operators import attribution as N
from quotary.operators import chunks, quotes, spans
from quotary.plans import matching
from quotary.plans.sql import CHAIN, keyed, one_byte, words
from quotary.sources.scratch import materialize
from quotary.sources.tables import table

#: Passages of a group of the canon, as it's numbered here.
GROUP = 8
#: Words that stand for the names of collections, of reports, openers and chains in the tables' texts.
COLLECTIONS = {"the": "first", "and": "second", "of": "first", "to": "second"}
REPORTED, INTRODUCES, CHAIN_WORD, OPENER, FROM, BREAKS = "^(in|is|it)$", "^(by|with|for)$", "^(that|this|be)$", "^(as|that|was)$", "^(of|to)$", "^(not|no|was)$"
#: Characters that are in no key of a word and no blanks. The others are listed one by one, as Java looks them up then; ranges take ten times as long.
NO_KEY = "[^" + "".join(map(chr, [*range(0x61, 0x7B), *range(0x30, 0x3A), *range(0xE0, 0x100), 0x20, *range(0x09, 0x0E)])) + "]+"
FORMULA, PERSON_STOP = ("the",), ("the", "and", "of", "to", "in")


def canon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / GROUP).alias("group"), (F.col("item_id") % GROUP + 1).alias("passage"), "text")


def numbered(s: DataFrame) -> DataFrame:
    """Chains with the numbers of their passage."""
    return s.withColumns({"group": F.floor(F.col("item_id") / GROUP), "passage": F.col("item_id") % GROUP + 1})


def found_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of a document that quotes the canon."""
    got = quotes.find_spans(table(spark, d, "documents"), canon(spark, d), "doc_id", "text", LATIN)
    return got.select("doc_id", "start", "end", "group", "passage", F.size("parts").cast("long").alias("parts"))


def kept_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches that aren't the document's own words in the canon's phrases."""
    docs, known = table(spark, d, "documents"), canon(spark, d)
    got = quotes.find_spans(docs, known, "doc_id", "text", LATIN)
    return quotes.drop_borrowed(got, docs, known, "doc_id", "text", LATIN).select("doc_id", "start", "end", "group", "passage")


def best_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of each passage most alike in each document, overlaps by score."""
    w = quotes.best_windows(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return quotes.overlaps_by_score(w, "doc_id", ["item_id"], "score", ["item_id"])


def span_references(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of passages in a row, from merged chains; a document's first chain is a claim that they widen."""
    s = numbered(matching.quoted_passages(spark, d))
    part = F.struct("group", "passage", F.col("w_start").alias("start"), F.col("w_end").alias("end")).cast(quotes.PART)
    merged = quotes.merge_parts(s.select("doc_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.array(part).alias("parts")), "doc_id")
    claims = s.groupBy("doc_id").agg(F.min_by(F.struct("group", "passage", F.col("w_start").alias("start"), (F.col("w_start") + 3).alias("end")), F.struct("w_start", "item_id")).alias("c"))
    claims = claims.select("doc_id", "c.group", "c.passage", "c.start", "c.end", F.lit(0.9).alias("confidence"), F.lit("claim").alias("method"))
    return quotes.widened_refs(claims, quotes.refs_from_spans(merged, "doc_id"), "doc_id")


def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Chains as located references, cards for even passages; overlaps settled."""
    s = numbered(matching.quoted_passages(spark, d))
    located = s.select("doc_id", F.col("item_id").alias("ref"), (F.col("item_id") % 2 == 0).alias("card"), "group", "passage", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.col("matched").alias("n_chars"))
    return A.resolve_located(located, "doc_id")


def _pairs_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, w, nxt): each line's words with the next one's. Characters that are in no key go from the whole text at once, and lines
    meet within their document's row."""
    text = F.regexp_replace(F.lower("text"), NO_KEY, "")
    lines = F.filter(F.transform(F.split(text, "\n"), X.words), lambda w: F.size(w) > 0)
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array(lines)).alias("w")).where("size(w) > 0")
    p = rows.select("doc_id", F.posexplode(F.arrays_zip("w", F.slice("w", 2, F.size("w")).alias("nxt"))).alias("line", "p"))
    return p.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "p.w", "p.nxt")


def yielded_tails(spark: SparkSession, d: str) -> DataFrame:
    """X11: references over two lines each give up the second to the reference that begins there."""
    p = _pairs_of_lines(spark, d).where("nxt is not null")
    refs = p.select("doc_id", F.col("line").alias("ref"), F.col("doc_id").alias("group"), F.col("line").alias("first"), (F.col("line") + 1).alias("last"), F.concat("w", "nxt").alias("words"))
    return A.yield_tails(refs, "doc_id", "ref")


def range_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two lines labelled with the second: the label steps back to the first."""
    p = _pairs_of_lines(spark, d)
    known = p.select(F.col("doc_id").alias("group"), F.col("line").alias("passage"), F.col("w").alias("words"))
    refs = p.where("nxt is not null").select(F.concat_ws(":", "doc_id", "line").alias("ref"), F.col("doc_id").alias("group"), (F.col("line") + 1).alias("passage"), F.concat("w", "nxt").alias("words"))
    return A.range_labels(refs, known, "ref")


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders as references, their lines as candidates of several sources."""
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("c1")).alias("named"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("p")).alias("person"))
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ref"), F.element_at(F.array(*map(F.lit, A.LINK_ORDER)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("source"), F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("collection"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("number"), F.col("l_quantity").cast("double").alias("score"), (F.col("l_partkey") % 2 == 0).alias("on_chain"),
    )
    return A.resolve_links(refs, c, "ref")


def _line_times(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, word, time, gap): lines said at 0.4 seconds a word, with a pause after each that its length decides."""
    line = matching.doc_lines(spark, d).select("doc_id", "line", F.size(X.words(F.col("t"))).cast("long").alias("n"), (F.length("t") % 7 / 2).alias("gap"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return line.select("doc_id", "line", upto("n").cast("long").alias("word"), F.round(upto(F.col("n") * 0.4 + F.col("gap")), 3).alias("time"), F.coalesce(F.lag("gap").over(Window.partitionBy("doc_id").orderBy("line")), F.lit(0.0)).alias("gap"))


def split_locations(spark: SparkSession, d: str) -> DataFrame:
    """Where a document falls into two: a passage's marker past a quarter of it, else the largest pause of its middle."""
    from quotary.plans.more import located_markers

    docs = table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"))
    marks = located_markers(spark, d).groupBy("doc_id").agg(F.min_by("pos", F.struct((-F.col("n")).alias("n"), "pos")).alias("word")).withColumn("time", F.round(F.col("word") * 0.4, 3))
    t = _line_times(spark, d).join(docs, "doc_id")
    inside = t.where((F.col("word") > 0.2 * F.col("n_words")) & (F.col("word") < 0.85 * F.col("n_words")))
    gaps = inside.groupBy("doc_id").agg(F.max(F.struct("gap", (-F.col("word")).alias("w"), "time")).alias("m")).select("doc_id", (-F.col("m.w")).alias("word"), "m.time", "m.gap")
    return A.split_location(docs, marks, gaps, "doc_id")


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks of prose chunks and cards, every word in exactly one."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(keys(F.col("text"), X.latin_key))).alias("words"))
    longest = materialize(matching.longest_spans(spark, d), "longest")
    touched = longest.where("item_id % 3 <> 0").select("doc_id", F.explode(F.sequence(F.floor(F.col("w_start") / 30), F.floor((F.col("w_end") - 1) / 30))).alias("chunk_idx")).distinct()
    cuts = chunks.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 30).join(touched, ["doc_id", "chunk_idx"], "left_anti").select("doc_id", F.col("chunk_idx").alias("chunk"), F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    known = canon(spark, d).select("item_id", F.explode(F.array(keys(F.col("text"), X.latin_key))).alias("passage"))
    refs = longest.join(known, "item_id").select("doc_id", F.col("item_id").alias("ref"), (F.col("item_id") % 3 == 0).alias("merges"), "passage", F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    got = A.assemble(docs, cuts, refs, "doc_id")
    return got.select("doc_id", "block", "kind", "start", "end", F.size("chunks").cast("long").alias("chunks"), F.size("refs").cast("long").alias("refs"))


def identified_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a chain identifies as a recitation."""
    n = canon(spark, d).select("item_id", F.size(X.words(F.col("text"))).alias("size"))
    s = numbered(matching.quoted_passages(spark, d)).join(n, "item_id").select("doc_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "group", "passage", "size")
    t = matching.doc_lines(spark, d).select("doc_id", "line", F.size(X.words(F.col("t"))).cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return A.identified_gaps(s, t.select("doc_id", (upto - F.col("n")).alias("start"), upto.alias("end")).where("start < end"), "doc_id")


def words_in_cards(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with two words or more that merged chains show in a card."""
    cuts = chunks.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 30).select("doc_id", F.col("chunk_idx").alias("chunk"), F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    cards = spans.merge_spans(matching.quoted_passages(spark, d), ["doc_id"]).select("doc_id", F.lit("card").alias("kind"), F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    return A.words_in_cards(cuts, cards, "doc_id")


def marking_faults(spark: SparkSession, d: str) -> DataFrame:
    """Passages of which a document's hits mark more than its longest chain says, or other words than an excerpt of their
    first half."""
    h = matching.hits(spark, d).groupBy("doc_id", "item_id").agg(F.min("q").alias("a"), (F.max("q") + 4).alias("b"))
    n = canon(spark, d).select("item_id", F.size(X.words(F.col("text"))).alias("n"))
    c = h.join(matching.longest_spans(spark, d), ["doc_id", "item_id"]).join(n, "item_id")
    cards = c.select("doc_id", "item_id", (F.col("w_end") - F.col("w_start")).alias("said"), (F.col("b") - F.col("a")).alias("marked"), F.concat_ws("-", "a", "b").alias("span"), F.concat_ws("-", F.lit(0), F.floor(F.col("n") / 2)).alias("excerpt_span"), (F.col("b") - F.col("a") >= F.col("n")).alias("whole"))
    return A.marking_faults(cards, ["doc_id", "item_id"])


def label_faults(spark: SparkSession, d: str) -> DataFrame:
    """Chains with two words to either side, labelled with their passage, some of them over two, some with another link."""
    s = numbered(matching.longest_spans(spark, d))
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(keys(F.col("text"), X.latin_key))).alias("_w"))
    lo = F.greatest(F.col("w_start") - 3, F.lit(0))
    refs = s.join(docs, "doc_id").select("doc_id", "item_id", "group", F.col("passage").alias("first"), (F.col("passage") + F.when(F.col("item_id") % 3 == 0, 1).otherwise(0)).alias("last"), F.concat_ws("/", "group", F.col("passage") + F.when(F.col("item_id") % 5 == 0, 1).otherwise(0)).alias("link"), F.slice("_w", (lo + 1).cast("int"), (F.col("w_end") + 2 - lo).cast("int")).alias("words"))
    known = canon(spark, d).select("group", "passage", keys(F.col("text"), X.latin_key).alias("words"))
    return A.label_faults(refs, known, ["doc_id", "item_id"], LATIN.stop)


def chunk_starts(spark: SparkSession, d: str) -> DataFrame:
    """Lines placed in their document by their leading words."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(keys(F.col("text"), X.latin_key))).alias("words"))
    line = matching.doc_lines(spark, d).select("doc_id", F.col("line").alias("chunk"), F.explode(F.array(keys(F.col("t"), X.latin_key))).alias("words")).where("size(words) > 0")
    return A.chunk_starts(line, docs, "doc_id")


def continued_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Chains in order as blocks, and whether each goes on with the passages of the one before."""
    s = numbered(matching.quoted_passages(spark, d))
    order = Window.partitionBy("doc_id").orderBy("w_start", "w_end", "item_id")
    refs = s.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("block"), "group", F.col("passage").alias("first"), (F.col("passage") + 6).alias("last"))
    return A.continued(refs, "doc_id", "block").select("doc_id", "block", "group", "first", "continues")


def collection_names(spark: SparkSession, d: str) -> DataFrame:
    """The collection named after or before each line of a document."""
    rows = N.light_rows(table(spark, d, "documents"), "doc_id", "text")
    t = matching.doc_lines(spark, d).select("doc_id", "line", F.size(X.words(F.col("t"))).cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    line = t.select("doc_id", (upto - F.col("n")).alias("start"), upto.alias("end")).where("start < end")
    return N.named_collections(line, rows, "doc_id", COLLECTIONS, REPORTED, INTRODUCES, CHAIN_WORD, LATIN.sentence_end)


def named_persons(spark: SparkSession, d: str) -> DataFrame:
    """The person named before each line."""
    rows = N.light_rows(table(spark, d, "documents"), "doc_id", "text")
    t = matching.doc_lines(spark, d).select("doc_id", "line", F.size(X.words(F.col("t"))).cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return N.named_persons(t.select("doc_id", (upto - F.col("n")).alias("start")).distinct(), rows, "doc_id", FROM, FORMULA, PERSON_STOP, BREAKS)


def attributed_quotes(spark: SparkSession, d: str) -> DataFrame:
    """What stands between an opener and an attribution, and the shortest passage of the collection that has it."""
    rows = N.light_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "light")
    known = canon(spark, d).select(F.when(F.col("item_id") % 2 == 0, "first").otherwise("second").alias("collection"), F.col("item_id").alias("passage"), keys(F.col("text"), X.latin_key).alias("words"))
    return N.attributed_quotes(rows, known, "doc_id", OPENER, REPORTED, COLLECTIONS)


def kept_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines as references by two methods: without those of the retired one and those without content."""
    line = matching.doc_lines(spark, d).select("doc_id", "line", "t", F.when(F.col("line") % 3 == 0, "scan").otherwise("ngram").alias("method"), F.col("t").rlike(r"[?!]$").alias("aloud"))
    return N.kept_references(line, ["doc_id", "line"], "method", "t", "scan").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").cast("long").alias("lines"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each document's references, by chains and by exact stretches."""
    a = matching.quoted_passages(spark, d).select("doc_id", (F.col("matched") >= 10).alias("matched"), F.lit("ngram").alias("method"))
    b = matching.exact_stretches(spark, d).select("doc_id", (F.col("w_end") - F.col("w_start") >= 10).alias("matched"), F.lit("exact").alias("method"))
    return N.summary(a.unionByName(b), ["doc_id"])


def citing_context(spark: SparkSession, d: str) -> DataFrame:
    """Each document's citing words and negations, and its chunks of 30 words that begin inside a plea."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array(X.words(F.col("text")))).alias("w"))
    c = w.select("doc_id", F.size(F.filter("w", lambda x: cites(x, LATIN))).cast("long").alias("citing"), F.size(F.filter("w", lambda x: is_negation(x, LATIN))).cast("long").alias("negations"))
    cut = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(30))).alias("at"))
    plea = cut.where(in_plea_sentence(F.col("w"), F.col("at"), LATIN)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pleas"))
    return c.join(plea, "doc_id", "left").na.fill(0, ["pleas"])


def phrase_cuts(spark: SparkSession, d: str) -> DataFrame:
    """places of the canon at which a cut would fall inside a fixed phrase."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.array(keys(F.col("text"), X.latin_key))).alias("w"))
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    return at.where(splits_phrase(F.col("w"), F.col("at"), LATIN)).select("item_id", F.col("at").cast("long").alias("at"))


def chained_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of overlapping chains of a document the one with more matched words, in order of position."""
    return quotes.overlaps_by_score(matching.quoted_passages(spark, d), "doc_id", ["item_id"], "matched", ["item_id"], "w_start", "w_end")


QUERIES = {
    f.__name__: f
    for f in (
        found_spans, kept_spans, best_windows, span_references, resolved_references, yielded_tails, range_labels, resolved_links, split_locations, assembled, identified_gaps, words_in_cards, marking_faults,
        label_faults, chunk_starts, continued_blocks, collection_names, named_persons, attributed_quotes, kept_references, run_summary, citing_context, phrase_cuts, chained_scores,
    )
}

_NUM = f"item_id // {GROUP} AS grp, item_id % {GROUP} + 1 AS psg"
_ONE = "longest AS (SELECT doc_id, item_id, w_start, w_end, matched FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY w_end - w_start DESC, w_start) AS r FROM spans) WHERE r = 1)"
_L = "l AS (SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_PLACED = f"pl AS (SELECT doc_id, line, sum(n) OVER o - n AS a, sum(n) OVER o AS b FROM (SELECT doc_id, line, len({words('t')}) AS n FROM l) WINDOW o AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))"
_TWO = f"tl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS line, w FROM (SELECT doc_id, line, list_filter({keyed('t')}, lambda w: w <> '') AS w FROM l) WHERE len(w) > 0), tp AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM tl)"
_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in COLLECTIONS.items()) + "}"
_MAP = lambda w: f"{_NAMES}[{w}]"
SQL = {
    "span_references": f"""WITH {CHAIN}, s AS (SELECT *, {_NUM} FROM spans),
m1 AS (SELECT *, max(w_end) OVER (PARTITION BY doc_id ORDER BY w_start, w_end, grp, psg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
m2 AS (SELECT *, sum(CASE WHEN w_start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY w_start, w_end, grp, psg ROWS UNBOUNDED PRECEDING) AS isle FROM m1),
r1 AS (SELECT *, CASE WHEN lag(grp) OVER o = grp AND lag(psg) OVER o + 1 = psg AND w_start <= lag(w_end) OVER o THEN 0 ELSE 1 END AS new FROM m2 WINDOW o AS (PARTITION BY doc_id, isle ORDER BY w_start, w_end)),
r2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, isle ORDER BY w_start, w_end ROWS UNBOUNDED PRECEDING) AS run FROM r1),
runs AS (SELECT doc_id, grp, min(psg) AS f, max(psg) AS l, min(w_start) AS a, max(w_end) AS b FROM r2 GROUP BY doc_id, isle, run, grp),
cl AS (SELECT doc_id, arg_min(grp, (w_start, item_id)) AS grp, arg_min(psg, (w_start, item_id)) AS psg, min(w_start) AS a FROM s GROUP BY doc_id),
j AS (SELECT cl.doc_id, arg_max((runs.f, runs.l, runs.a, runs.b), (runs.b - runs.a, -runs.a)) AS w FROM cl JOIN runs ON cl.doc_id = runs.doc_id AND cl.grp = runs.grp AND psg BETWEEN f AND l WHERE runs.b - runs.a > 3 GROUP BY cl.doc_id)
SELECT doc_id, grp AS "group", coalesce(w[1], psg) AS first, coalesce(w[2], psg) AS last, coalesce(w[3], a) AS start, coalesce(w[4], a + 3) AS "end", 0.9::DOUBLE AS confidence, 'claim' AS method FROM cl LEFT JOIN j USING (doc_id)
UNION ALL SELECT doc_id, grp, f, l, a, b, 0.8::DOUBLE, 'ngram' FROM runs WHERE b - a >= 5 AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = runs.doc_id AND cl.grp = runs.grp AND psg BETWEEN f AND l)""",
    "resolved_references": f"""WITH {CHAIN}, s AS (SELECT doc_id, list({{'s': w_start, 'r': item_id, 'e': w_end, 'c': item_id % 2 = 0, 'n': matched}} ORDER BY w_start, item_id) AS c FROM spans GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_reduce(c, lambda a, x: CASE WHEN len(a) = 0 OR x.s >= a[-1].e THEN list_append(a, x)
  WHEN a[-1].c AND x.c AND a[-1].r <> x.r AND x.s > a[-1].s THEN list_concat(a[1:len(a) - 1], [{{'s': a[-1].s, 'r': a[-1].r, 'e': x.s, 'c': a[-1].c, 'n': a[-1].n}}, x])
  WHEN x.n > a[-1].n THEN list_append(a[1:len(a) - 1], x) ELSE a END, c[1:0])) AS k FROM s)
SELECT doc_id, k.r AS ref, k.s AS start, k.e AS "end" FROM f""",
    "yielded_tails": f"""WITH {_L}, {_TWO}, r AS (SELECT doc_id, line, list_concat(w, nxt) AS w FROM tp WHERE nxt IS NOT NULL),
j AS (SELECT a.doc_id, a.line, list_min(list_filter(range(1, greatest(len(a.w) - len(b.w[1:4]), 1) + 1), lambda p: a.w[p + 1:p + len(b.w[1:4])] = b.w[1:4])) AS cut FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.line = a.line + 1 WHERE len(b.w[1:4]) >= 3)
SELECT r.doc_id, r.line AS ref, r.line AS first, CASE WHEN cut IS NOT NULL THEN r.line ELSE r.line + 1 END AS last, coalesce(cut, len(w))::BIGINT AS n_words FROM r LEFT JOIN j USING (doc_id, line)""",
    "resolved_links": f"""WITH r AS (SELECT o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'c1' END AS named, o_orderkey % 5 = 0 AS person FROM orders),
c AS (SELECT l_orderkey AS ref, l_suppkey % 6 + 1 AS o, {list(A.LINK_ORDER)}[l_suppkey % 6 + 1] AS source, 'c' || (l_linenumber % 3) AS collection, l_partkey || '-' || l_linenumber AS number, l_quantity::DOUBLE AS score, l_partkey % 2 = 0 AS chain FROM lineitem),
j AS (SELECT r.*, c.* EXCLUDE (ref), source IS NOT NULL AND (named IS NULL OR (collection = named AND source NOT IN ('unnamed', 'claimed'))) AS fits, NOT person OR coalesce(chain, true) AS his FROM r LEFT JOIN c USING (ref)),
b AS (SELECT ref, any_value(named) AS named, bool_or(fits AND NOT his) AS others, arg_min((collection, number, source), (o, -score, collection, number)) FILTER (WHERE fits AND his) AS b FROM j GROUP BY ref)
SELECT ref, coalesce(b[1], named) AS collection, b[2] AS number, b[3] AS source, CASE WHEN b IS NOT NULL THEN NULL WHEN others THEN '{A.NOT_HIS}' WHEN named IS NOT NULL THEN '{A.UNLINKED}' END AS note FROM b""",
    "identified_gaps": f"""WITH {CHAIN}, {_L}, {_PLACED}, z AS (SELECT item_id, len({words('text')}) AS size FROM benchmark), s AS (SELECT *, {_NUM} FROM spans JOIN z USING (item_id)),
g AS (SELECT pl.doc_id, a, b, grp, psg, w_end - w_start AS n, w_start FROM pl JOIN s ON pl.doc_id = s.doc_id AND w_start >= a AND w_end <= b WHERE a < b AND ((size >= 3 AND w_end - w_start >= size) OR w_end - w_start >= greatest(5, ceil((b - a) * 0.6))))
SELECT doc_id, a::BIGINT AS start, b::BIGINT AS "end", grp AS "group", psg AS passage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b ORDER BY n DESC, w_start, grp, psg) AS r FROM g) WHERE r = 1""",
    "words_in_cards": f"""WITH {CHAIN}, m1 AS (SELECT *, max(w_end) OVER (PARTITION BY doc_id ORDER BY w_start, w_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
m2 AS (SELECT *, sum(CASE WHEN w_start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY w_start, w_end ROWS UNBOUNDED PRECEDING) AS isle FROM m1), m AS (SELECT doc_id, min(w_start) AS a, max(w_end) AS b FROM m2 GROUP BY doc_id, isle),
n AS (SELECT doc_id, len({words('text')})::BIGINT AS n FROM documents), c AS (SELECT doc_id, i AS chunk, i * 30 AS s, least((i + 1) * 30, n) AS e FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 30.0) AS BIGINT))) AS i FROM n))
SELECT c.doc_id, chunk, sum(least(e, b) - greatest(s, a))::BIGINT AS n FROM c JOIN m ON c.doc_id = m.doc_id AND a < e AND b > s GROUP BY ALL HAVING sum(least(e, b) - greatest(s, a)) >= 2""",
    "marking_faults": f"""WITH {CHAIN}, {_ONE}, h AS (SELECT doc_id, item_id, min(q) AS a, max(q) + 4 AS b FROM hits GROUP BY ALL), z AS (SELECT item_id, len({words('text')}) AS n FROM benchmark),
c AS (SELECT * FROM h JOIN longest USING (doc_id, item_id) JOIN z USING (item_id))
SELECT doc_id, item_id, 'marked more than said' AS fault FROM c WHERE b - a > 1.5 * (w_end - w_start) + 4 UNION ALL SELECT doc_id, item_id, 'stale excerpt' FROM c WHERE b - a < n AND (a || '-' || b) <> ('0-' || (n // 2))""",
    "label_faults": f"""WITH {CHAIN}, {_ONE}, cw AS (SELECT item_id, {keyed('text')} AS w, {_NUM} FROM benchmark), dw AS (SELECT doc_id, {keyed('text')} AS w FROM documents),
r AS (SELECT doc_id, item_id, {_NUM}, w[greatest(w_start - 3, 0) + 1:w_end + 2] AS said FROM longest JOIN dw USING (doc_id)),
c AS (SELECT r.doc_id, r.item_id, list_distinct(flatten(list(cw.w))) AS cited FROM r JOIN cw ON cw.grp = r.grp AND cw.psg BETWEEN r.psg AND r.psg + CASE WHEN r.item_id % 3 = 0 THEN 1 ELSE 0 END GROUP BY ALL),
o AS (SELECT *, list_transform(said, lambda x: list_contains(cited, x) OR (length(x) >= 4 AND len(list_filter(cited, lambda v: levenshtein({one_byte('x')}, {one_byte('v')}) <= 1)) > 0)) AS own FROM r LEFT JOIN c USING (doc_id, item_id)),
h AS (SELECT *, coalesce(list_position(own, true), len(said) + 1) - 1 AS head, coalesce(list_position(list_reverse(own), true), len(said) + 1) - 1 AS tail FROM o)
SELECT doc_id, item_id, 'link' AS fault FROM h WHERE item_id % 5 = 0 UNION ALL SELECT doc_id, item_id, 'no passage' FROM h WHERE cited IS NULL
UNION ALL SELECT doc_id, item_id, 'other text' FROM h WHERE len(list_filter(said, lambda x: list_contains(cited, x))) < 0.5 * greatest(len(said), 1) AND cited IS NOT NULL
UNION ALL SELECT doc_id, item_id, 'end' FROM h WHERE cited IS NOT NULL AND tail >= 2 AND tail < len(said)
UNION ALL SELECT doc_id, item_id, 'start' FROM h WHERE cited IS NOT NULL AND head < len(said) AND len(list_filter(said[1:head], lambda x: x NOT IN {LATIN.stop})) >= 3""",
    "continued_blocks": f"""WITH {CHAIN}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w_start, w_end, item_id) - 1 AS block, {_NUM} FROM spans)
SELECT doc_id, block, grp AS "group", psg AS first, coalesce(lag(grp) OVER o = grp AND psg BETWEEN lag(psg) OVER o AND lag(psg) OVER o + 7, false) AS continues FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY block)""",
    "collection_names": f"""WITH {_L}, {_PLACED}, d AS (SELECT doc_id, {words('text')} AS r, {keyed('text')} AS k FROM documents),
s AS (SELECT doc_id, a, b, k[b + 1:b + 6] AS af, k[greatest(a - 30, 0) + 1:a] AS bf, r[greatest(a - 30, 0) + 1:a] AS rf FROM pl JOIN d USING (doc_id) WHERE a < b),
t AS (SELECT *, list_position(list_transform(af[1:3], lambda w: regexp_matches(w, '{REPORTED}')), true) AS told, list_max(list_filter(range(1, len(bf) + 1), lambda i: regexp_matches(bf[i], '{INTRODUCES}') AND {_MAP('bf[i + 1]')} IS NOT NULL)) AS i FROM s),
u AS (SELECT *, CASE WHEN told > 0 THEN {_MAP('af[told + 1]')} END AS rt, CASE WHEN i IS NOT NULL AND len(list_filter(bf[i + 2:len(bf)], lambda w: regexp_matches(w, '{CHAIN_WORD}'))) > 0 AND len(list_filter(rf[i + 2:len(rf)], lambda w: regexp_matches(w, '{LATIN.sentence_end}'))) = 0 THEN {_MAP('bf[i + 1]')} END AS lt FROM t)
SELECT doc_id, a::BIGINT AS start, b::BIGINT AS "end", coalesce(rt, lt) AS collection, CASE WHEN rt IS NOT NULL THEN 'after' ELSE 'before' END AS side FROM u WHERE rt IS NOT NULL OR lt IS NOT NULL""",
    "named_persons": f"""WITH {_L}, {_PLACED}, d AS (SELECT doc_id, {keyed('text')} AS k FROM documents), s AS (SELECT DISTINCT doc_id, a, k[greatest(a - 60, 0) + 1:a] AS b FROM pl JOIN d USING (doc_id)),
t AS (SELECT *, list_max(list_filter(range(1, len(b) + 1), lambda i: regexp_matches(b[i], '{FROM}') AND list_contains(b[i + 2:i + 6], 'the'))) AS i FROM s), u AS (SELECT *, list_position(b[i + 2:i + 6], 'the') AS n FROM t WHERE i IS NOT NULL),
v AS (SELECT *, list_filter(b[i + 1:i + n], lambda w: w NOT IN {PERSON_STOP} AND length(w) >= 3)[1] AS person FROM u WHERE len(list_filter(b[i + n + 2:len(b)], lambda w: regexp_matches(w, '{BREAKS}'))) = 0)
SELECT doc_id, a::BIGINT AS start, person FROM v WHERE person IS NOT NULL""",
    "attributed_quotes": f"""WITH d AS (SELECT doc_id, {keyed('text')} AS k FROM documents), c AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'first' ELSE 'second' END AS collection, len({words('text')}) AS n, ' ' || array_to_string({keyed('text')}, ' ') || ' ' AS t FROM benchmark),
a AS (SELECT doc_id, k, i - 1 AS i, list_filter(list_transform(k[i + 1:i + 3], lambda w: {_MAP('w')}), lambda x: x IS NOT NULL)[1] AS collection FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM d) WHERE regexp_matches(k[i], '{REPORTED}')),
q AS (SELECT *, greatest(i - 40, 0) + list_max(list_filter(range(1, least(i, 40) + 1), lambda j: regexp_matches(k[greatest(i - 40, 0) + j], '{OPENER}'))) AS s FROM a WHERE collection IS NOT NULL),
w AS (SELECT doc_id, s, i, collection, ' ' || array_to_string(k[s + 1:i], ' ') || ' ' AS t FROM q WHERE i - s BETWEEN 2 AND 40)
SELECT doc_id, s::BIGINT AS start, i::BIGINT AS "end", w.collection, arg_min(item_id, (n, item_id)) AS passage FROM w JOIN c ON w.collection = c.collection AND contains(c.t, w.t) GROUP BY ALL""",
    "kept_references": f"WITH {_L} SELECT doc_id, count(*)::BIGINT AS n, sum(line)::BIGINT AS lines FROM l WHERE line % 3 <> 0 AND (len({words('t')}) >= 4 OR (regexp_matches(t, '[?!]$') AND len({words('t')}) >= 2)) GROUP BY doc_id",
    "run_summary": f"""WITH {CHAIN}, st0 AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS i FROM hits), st AS (SELECT doc_id, max(p) + 4 - min(p) AS n FROM st0 GROUP BY doc_id, item_id, p - q, i HAVING max(p) + 4 - min(p) >= 5),
u AS (SELECT doc_id, matched >= 10 AS m, true AS g FROM spans UNION ALL SELECT doc_id, n >= 10, false FROM st) SELECT doc_id, count(*)::BIGINT AS found, count(*) FILTER (WHERE m)::BIGINT AS matched, count(*) FILTER (WHERE g)::BIGINT AS by_scan FROM u GROUP BY doc_id""",
    "citing_context": f"""WITH d AS (SELECT doc_id, {words('text')} AS r, {keyed('text')} AS k FROM documents), c AS (SELECT doc_id, len(list_filter(k, lambda w: regexp_matches(w, '{LATIN.citing}')))::BIGINT AS citing, len(list_filter(k, lambda w: regexp_matches(w, '{LATIN.negation}')))::BIGINT AS negations FROM d),
x AS (SELECT doc_id, a, r[greatest(a - 30, 0) + 1:a] AS r, k[greatest(a - 30, 0) + 1:a] AS k FROM (SELECT *, unnest(range(0, greatest(len(r), 1), 30)) AS a FROM d)),
y AS (SELECT *, coalesce(list_max(list_filter(range(1, len(r) + 1), lambda i: regexp_matches(r[i], '{LATIN.sentence_end}'))), 0) AS e FROM x), z AS (SELECT *, list_max(list_filter(range(e + 1, len(k) + 1), lambda i: regexp_matches(k[i], '{LATIN.plea}'))) AS p FROM y),
v AS (SELECT doc_id, count(*) AS n FROM z WHERE p IS NOT NULL AND len(list_filter(k[p + 1:len(k)], lambda w: regexp_matches(w, '{LATIN.citing}'))) = 0 GROUP BY doc_id) SELECT c.*, coalesce(n, 0)::BIGINT AS pleas FROM c LEFT JOIN v USING (doc_id)""",
    "phrase_cuts": f"WITH w AS (SELECT item_id, k, unnest(range(1, len(k))) AS i FROM (SELECT item_id, {keyed('text')} AS k FROM benchmark)) SELECT item_id, i::BIGINT AS at FROM w WHERE k[i] || ' ' || k[i + 1] IN {LATIN.phrases}",
    "chained_scores": f"""WITH {CHAIN}, s AS (SELECT doc_id, list({{'s': w_start, 'i': item_id, 'e': w_end, 'm': matched}} ORDER BY w_start, item_id, w_end) AS c FROM spans GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_reduce(c, lambda a, x: CASE WHEN len(a) = 0 OR x.s >= a[-1].e THEN list_append(a, x) WHEN x.m > a[-1].m THEN list_append(a[1:len(a) - 1], x) ELSE a END, c[1:0])) AS k FROM s)
SELECT doc_id, k.s AS w_start, k.e AS w_end, k.m AS matched, k.i AS item_id FROM f""",
}
