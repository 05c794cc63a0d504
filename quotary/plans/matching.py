"""Queries of the text-matching operators: documents against the canon of benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.functions.lang import LATIN
from quotary.operators import chunks, grams, refs, spans
from quotary.plans.sql import CHAIN, HITS, REPEATS, keyed, words
from quotary.sources.scratch import materialize
from quotary.sources.tables import table


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    docs = grams.hashed_grams(table(spark, d, "documents"), ["doc_id"], "text")
    canon = grams.hashed_grams(table(spark, d, "benchmark"), ["item_id"], "text")
    return grams.gram_join(docs, canon, "doc_id", ["item_id"])


def quoted_passages(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: J1, J2, W1."""
    return spans.chain_hits(hits(spark, d), ["doc_id", "item_id"])


def gram_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits by document and passage."""
    return hits(spark, d).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("hits"), F.min("p").alias("first_p"), F.max("p").alias("last_p"))


def gram_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each 4-gram of the canon stands."""
    docs = grams.hashed_grams(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "h", "c")
    named = grams.grams(table(spark, d, "benchmark"), "item_id", "text").select("gram").distinct()
    canon = named.select("gram", F.explode(grams.gram_hashes(F.split("gram", " "), 4)).alias("g")).select("gram", "g.h", "g.c")
    return docs.join(canon, ["h", "c"]).groupBy("gram").agg(F.count_distinct("doc_id").alias("df"), F.count(F.lit(1)).alias("n"))


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a document merged over passages."""
    return spans.merge_spans(quoted_passages(spark, d), ["doc_id"], gap=2, carry="item_id").select("doc_id", "w_start", "w_end", "parts", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def longest_spans(spark: SparkSession, d: str) -> DataFrame:
    """The longest span of each passage in each document."""
    return spans.longest_per(quoted_passages(spark, d), ["doc_id", "item_id"]).select("doc_id", "item_id", "w_start", "w_end", "matched")


def exact_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Exact stretches of five words or more."""
    return spans.diagonal_islands(hits(spark, d), ["doc_id", "item_id"]).where("w_end - w_start >= 5")


def uncovered_words(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of quoting documents that no span covers."""
    merged = spans.merge_spans(quoted_passages(spark, d), ["doc_id"])
    sizes = table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words")).join(merged.select("doc_id").distinct(), "doc_id", "left_semi")
    return spans.uncovered(merged, sizes, "doc_id")


def selected_spans(spark: SparkSession, d: str) -> DataFrame:
    """The most matched first, no shared words."""
    return spans.select_non_overlapping(quoted_passages(spark, d), ["doc_id"], [-F.col("matched"), F.col("item_id")])


def consecutive_items(spark: SparkSession, d: str) -> DataFrame:
    """Passages that follow each other and are quoted in one document, as ranges."""
    return spans.consecutive_runs(quoted_passages(spark, d), ["doc_id"], "item_id")


def best_passage(spark: SparkSession, d: str) -> DataFrame:
    """For each line of a document the passage of the highest score."""
    return refs.best_match(doc_lines(spark, d), ["doc_id", "line"], "t", table(spark, d, "benchmark"), "item_id", "text")


def best_bodies(spark: SparkSession, d: str) -> DataFrame:
    """For each line the passage by the rule for short and long texts, bracketed asides left out."""
    return refs.best_body(doc_lines(spark, d), ["doc_id", "line"], "t", table(spark, d, "benchmark"), "item_id", "text")


def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """The passage of a document's first chain as its claim, against the best match of its lines."""
    claims = quoted_passages(spark, d).groupBy("doc_id").agg(F.min_by("item_id", F.struct("w_start", "item_id")).alias("claimed"))
    best = best_passage(spark, d).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("i"))).alias("b")).select("doc_id", (-F.col("b.i")).alias("item_id"), "b.score")
    return refs.cross_check(claims, best, ["doc_id"], "claimed", "item_id", "score")


def dedupe_contained(spark: SparkSession, d: str) -> DataFrame:
    """Passages and prefixes of them; texts that another one holds go."""
    canon = table(spark, d, "benchmark")
    prefix = canon.select((F.col("item_id") + 100000).alias("item_id"), F.array_join(F.slice(X.words(F.col("text")), 1, 12), " ").alias("text"), F.lit(1).alias("rank"))
    both = canon.select("item_id", F.array_join(X.words(F.col("text")), " ").alias("text"), F.lit(0).alias("rank")).unionByName(prefix)
    return refs.drop_contained(both, "item_id", "text", "rank").select("item_id", F.length("text").cast("long").alias("n_chars"))


def located_passages(spark: SparkSession, d: str) -> DataFrame:
    """The shortest prefix of five words or more that stands exactly once in a document, else five words from the second
    to the fifth on that do."""
    return refs.locate_unique(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text", back=4)


def restarts(spark: SparkSession, d: str) -> DataFrame:
    """Runs of five words said again within 30; short ones only right after each other, and with three words that are no
    formula."""
    return chunks.find_repeats(table(spark, d, "documents"), "doc_id", "text", formula=LATIN.formula)


def inline_share(spark: SparkSession, d: str) -> DataFrame:
    """Spans against fixed chunks of 30 words; at least half inside one is inline."""
    chunk = chunks.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 30)
    return refs.classify_inline(quoted_passages(spark, d), chunk, "doc_id", 30).select("doc_id", "item_id", "w_start", "chunk_idx", "share", "inline")


def refs_per_document(spark: SparkSession, d: str) -> DataFrame:
    """A document's references in order, as one row."""
    r = quoted_passages(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("w_start", "item_id"))).alias("r"))
    return r.select("doc_id", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["w_start"], x["item_id"])), " ").alias("refs"))


def expected_actual(spark: SparkSession, d: str) -> DataFrame:
    """Expected passages, those that stand in a document word for word, against those that its exact stretches of
    twenty words name, as multisets."""
    found = exact_stretches(spark, d).where("w_end - w_start >= 20").select("doc_id", "item_id")
    items = table(spark, d, "benchmark").select("item_id", F.array_join(X.words(F.col("text")), " ").alias("b"))
    flat = table(spark, d, "documents").select("doc_id", F.array_join(X.words(F.col("text")), " ").alias("t"))
    near_by = hits(spark, d).select("doc_id", "item_id").distinct()
    want = near_by.join(items, "item_id").join(flat, "doc_id").where(F.contains("t", F.col("b"))).select("doc_id", "item_id")
    missing = want.exceptAll(found).withColumn("side", F.lit("missing"))
    extra = found.exceptAll(want).withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def positions_in_canon(spark: SparkSession, d: str) -> DataFrame:
    """How much of the passage each document says: first and last word, share."""
    s = spans.chain_hits(hits(spark, d).select("doc_id", "item_id", F.col("q").alias("p"), F.col("p").alias("q")).distinct(), ["doc_id", "item_id"])
    n = table(spark, d, "benchmark").select("item_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"))
    t = s.groupBy("doc_id", "item_id").agg(F.min("w_start").alias("first"), F.max("w_end").alias("last"))
    return t.join(n, "item_id").select("doc_id", "item_id", "first", "last", X.half_up((F.col("last") - F.col("first")) / F.col("n_words")).alias("share"))


def best_offset(spark: SparkSession, d: str) -> DataFrame:
    """The shift at which most hits of a passage agree."""
    shift = hits(spark, d).groupBy("doc_id", "item_id", (F.col("p") - F.col("q")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id", "item_id").orderBy(F.col("n").desc(), "shift")
    return shift.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def tagged_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of detection united, by method."""
    h = materialize(hits(spark, d), "hits")
    a = spans.chain_hits(h, ["doc_id", "item_id"]).select("doc_id", "item_id", F.lit("chain").alias("method"))
    b = spans.diagonal_islands(h, ["doc_id", "item_id"]).where("w_end - w_start >= 5").select("doc_id", "item_id", F.lit("exact").alias("method"))
    return a.unionByName(b).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def liturgical_share(spark: SparkSession, d: str) -> DataFrame:
    """documents' lines that are, in words, mostly one of the passages: at least 0.55 alike, or 0.75 inside one, or
    0.85 inside all together."""
    line = doc_lines(spark, d).where(F.size(X.words(F.col("t"))) >= 3)
    return refs.like_any(line, ["doc_id", "line"], "t", table(spark, d, "benchmark"), "item_id", "text", 0.55, 0.75, 0.85)


QUERIES = {f.__name__: f for f in (quoted_passages, gram_hits, gram_document_frequency, merged_spans, longest_spans, exact_stretches, uncovered_words, selected_spans, consecutive_items, best_passage, best_bodies, cross_check, dedupe_contained, located_passages, restarts, inline_share, refs_per_document, expected_actual, positions_in_canon, best_offset, tagged_layers, liturgical_share)}

_MERGED = """m1 AS (SELECT *, max(w_end) OVER (PARTITION BY doc_id ORDER BY w_start, w_end, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(item_id) OVER (PARTITION BY doc_id ORDER BY w_start, w_end, item_id) AS before FROM spans),
m2 AS (SELECT *, sum(CASE WHEN w_start <= reach OR (before = item_id AND w_start <= reach + {gap}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY w_start, w_end, item_id ROWS UNBOUNDED PRECEDING) AS isle FROM m1),
merged AS (SELECT doc_id, min(w_start) AS w_start, max(w_end) AS w_end, count(*)::BIGINT AS parts, list_sort(list(DISTINCT item_id)) AS ids FROM m2 GROUP BY doc_id, isle)"""
_STRETCH = """st0 AS (SELECT *, p - q AS d, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS i FROM hits),
st AS (SELECT doc_id, item_id, min(p) AS w_start, max(p) + 4 AS w_end, min(q) AS q_start FROM st0 GROUP BY doc_id, item_id, d, i HAVING max(p) + 4 - min(p) >= 5)"""
_LINES = f"""l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, (i - 1)::INTEGER AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l0)),
l AS (SELECT doc_id, line, t, list_distinct(list_filter({keyed('t')}, lambda w: w <> '')) AS w FROM l1), lt AS (SELECT doc_id, line, len(w) AS n, unnest(w) AS w FROM l),
b AS (SELECT item_id, list_distinct(list_filter({keyed('text')}, lambda w: w <> '')) AS w FROM benchmark), bt AS (SELECT item_id, len(w) AS m, unnest(w) AS w FROM b),
sh AS (SELECT doc_id, line, item_id, count(*) AS s, any_value(n) AS n, any_value(m) AS m FROM lt JOIN bt USING (w) GROUP BY doc_id, line, item_id)"""
_BEST = f"""{_LINES}, sc AS (SELECT *, s::DOUBLE / (n + m - s) AS j FROM sh),
sr AS (SELECT *, CASE WHEN s = n OR s = m THEN greatest(j, 0.8::DOUBLE) WHEN n >= 3 AND s >= 0.75 * n THEN greatest(j, 0.7::DOUBLE) ELSE j END AS raw FROM sc),
best AS (SELECT doc_id, line, item_id, floor(raw * 100 + 0.5) / 100 AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY raw DESC, item_id) AS r FROM sr WHERE raw >= 0.4::DOUBLE) WHERE r = 1)"""
_ASIDES = r"regexp_replace(t, '\s+(?:أي|يعني)\s+\S+(?:\s+\S+){0,3}|\([^)]*\)', ' ', 'g')"

SQL = {
    "quoted_passages": f"WITH {CHAIN} SELECT * FROM spans",
    "gram_hits": f"WITH {HITS} SELECT doc_id, item_id, count(*)::BIGINT AS hits, min(p) AS first_p, max(p) AS last_p FROM hits GROUP BY ALL",
    "gram_document_frequency": f"WITH {HITS} SELECT gram, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS n FROM dg JOIN (SELECT DISTINCT gram FROM bg) USING (gram) GROUP BY gram",
    "merged_spans": f"WITH {CHAIN}, {_MERGED.format(gap=2)} SELECT doc_id, w_start, w_end, parts, array_to_string(ids, ',') AS ids FROM merged",
    "longest_spans": f"WITH {CHAIN} SELECT doc_id, item_id, w_start, w_end, matched FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY w_end - w_start DESC, w_start) AS r FROM spans) WHERE r = 1",
    "exact_stretches": f"WITH {HITS}, {_STRETCH} SELECT * FROM st",
    "uncovered_words": f"""WITH {CHAIN}, {_MERGED.format(gap=0)},
n AS (SELECT doc_id, len({words('text')})::BIGINT AS n_words FROM documents),
g AS (SELECT doc_id, coalesce(lag(w_end) OVER (PARTITION BY doc_id ORDER BY w_start), 0) AS gap_start, w_start AS gap_end FROM merged
  UNION ALL SELECT doc_id, max(w_end), any_value(n_words) FROM merged JOIN n USING (doc_id) GROUP BY doc_id)
SELECT * FROM g WHERE gap_start < gap_end""",
    "selected_spans": f"""WITH {CHAIN}, s AS (SELECT doc_id, list({{'s': w_start, 'e': w_end}} ORDER BY matched DESC, item_id, w_start, w_end) AS c FROM spans GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_reduce(c, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x.e AND y.e > x.s)) > 0 THEN a ELSE list_append(a, x) END, c[1:0])) AS k FROM s) SELECT doc_id, k.s AS w_start, k.e AS w_end FROM f""",
    "consecutive_items": f"""WITH {CHAIN}, u AS (SELECT DISTINCT doc_id, item_id FROM spans), i AS (SELECT *, item_id - row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS g FROM u)
SELECT doc_id, min(item_id) AS first, max(item_id) AS last, count(*)::BIGINT AS n FROM i GROUP BY doc_id, g""",
    "best_passage": f"WITH {_BEST} SELECT * FROM best",
    "best_bodies": f"""WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, (i - 1)::INTEGER AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l0)),
l2 AS (SELECT doc_id, line, {_ASIDES} AS t FROM l1), l AS (SELECT doc_id, line, list_filter({keyed('t')}, lambda w: w <> '') AS w FROM l2), lt AS (SELECT doc_id, line, unnest(list_distinct(w)) AS w FROM l),
b AS (SELECT item_id, list_filter({keyed('text')}, lambda w: w <> '') AS a FROM benchmark), bt AS (SELECT item_id, unnest(list_distinct(a)) AS w FROM b),
sh AS (SELECT doc_id, line, item_id, count(*) AS s FROM lt JOIN bt USING (w) GROUP BY doc_id, line, item_id),
f AS (SELECT sh.*, l.w, b.a, len(list_distinct(l.w)) AS n, len(list_distinct(b.a)) AS m FROM sh JOIN l USING (doc_id, line) JOIN b USING (item_id) WHERE s >= 0.5 * len(list_distinct(l.w)) OR s = len(list_distinct(b.a))),
x AS (SELECT *, s::DOUBLE / (n + m - s) AS j, ' ' || array_to_string(w, ' ') || ' ' AS jw, ' ' || array_to_string(a, ' ') || ' ' AS ja FROM f),
r AS (SELECT *, len(w) < 6 AS few, CASE WHEN len(w) < 6 THEN CASE WHEN s = n THEN len(w)::DOUBLE / len(a) END WHEN contains(jw, ja) OR contains(ja, jw) THEN greatest(j, 0.8::DOUBLE)
  WHEN len(list_filter(w, lambda q: list_contains(a, q))) >= 0.75 * len(w) THEN greatest(j, 0.65::DOUBLE) ELSE j END AS raw FROM x)
SELECT doc_id, line, item_id, floor(raw * 100 + 0.5) / 100 AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY raw DESC, item_id) AS k FROM r WHERE raw >= CASE WHEN few THEN 0.08 ELSE 0.5 END::DOUBLE) WHERE k = 1""",
    "cross_check": f"""WITH {CHAIN}, {_BEST}, c AS (SELECT doc_id, arg_min(item_id, (w_start, item_id)) AS claimed FROM spans GROUP BY doc_id),
o AS (SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM best) WHERE r = 1)
SELECT doc_id, claimed, item_id, CASE WHEN claimed IS NULL OR (claimed <> item_id AND score >= 0.95) THEN item_id ELSE claimed END AS chosen,
CASE WHEN item_id IS NULL THEN 0.85 WHEN claimed IS NULL THEN score WHEN claimed = item_id THEN greatest(0.95, score) ELSE 0.75 END::DOUBLE AS confidence,
CASE WHEN item_id IS NULL THEN 'claim only' WHEN claimed IS NULL THEN 'match only' WHEN claimed = item_id THEN 'agree' ELSE 'disagree' END AS verdict FROM c FULL JOIN o USING (doc_id)""",
    "dedupe_contained": f"""WITH w AS (SELECT item_id, {words('text')} AS w FROM benchmark),
a AS (SELECT item_id, array_to_string(w, ' ') AS text, 0 AS rank FROM w UNION ALL SELECT item_id + 100000, array_to_string(w[1:12], ' '), 1 FROM w)
SELECT a.item_id, length(a.text)::BIGINT AS n_chars FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.item_id <> a.item_id AND contains(b.text, a.text) AND (length(b.text) > length(a.text) OR (b.rank, b.item_id) < (a.rank, a.item_id)))""",
    "restarts": f"""WITH RECURSIVE {REPEATS} SELECT doc_id, i AS from_pos, j AS again_pos, n AS n_words FROM good""",
    "inline_share": f"""WITH {CHAIN},
n AS (SELECT doc_id, len({words('text')})::BIGINT AS n FROM documents),
c AS (SELECT doc_id, i AS chunk_idx, i * 30 AS c_start, least((i + 1) * 30, n) AS c_end FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 30.0) AS BIGINT))) AS i FROM n)),
o AS (SELECT s.doc_id, item_id, w_start, chunk_idx, floor((least(w_end, c_end) - greatest(w_start, c_start))::DOUBLE / (w_end - w_start) * 100 + 0.5) / 100 AS share FROM spans s JOIN c ON s.doc_id = c.doc_id AND w_start < c_end AND w_end > c_start)
SELECT *, share >= 0.5 AS inline FROM o""",
    "refs_per_document": f"WITH {CHAIN} SELECT doc_id, count(*)::BIGINT AS n, string_agg(w_start || ':' || item_id, ' ' ORDER BY w_start, item_id) AS refs FROM spans GROUP BY doc_id",
    "positions_in_canon": f"""WITH {CHAIN.replace('dg.pos AS p, bg.pos AS q', 'bg.pos AS p, dg.pos AS q').replace('hits AS (SELECT doc_id', 'hits AS (SELECT DISTINCT doc_id')},
n AS (SELECT item_id, len({words('text')})::BIGINT AS n FROM benchmark), t AS (SELECT doc_id, item_id, min(w_start) AS first, max(w_end) AS last FROM spans GROUP BY ALL)
SELECT doc_id, item_id, first, last, floor((last - first)::DOUBLE / n * 100 + 0.5) / 100 AS share FROM t JOIN n USING (item_id)""",
    "best_offset": f"WITH {HITS}, s AS (SELECT doc_id, item_id, p - q AS shift, count(*)::BIGINT AS n FROM hits GROUP BY ALL) SELECT doc_id, item_id, shift, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) AS r FROM s) WHERE r = 1",
    "tagged_layers": f"WITH {CHAIN}, {_STRETCH} SELECT 'chain' AS method, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM spans HAVING count(*) > 0 UNION ALL SELECT 'exact', count(*)::BIGINT, count(DISTINCT doc_id)::BIGINT FROM st HAVING count(*) > 0",
    "located_passages": f"""WITH d AS (SELECT doc_id, {keyed('text')} AS w FROM documents), b AS (SELECT item_id, {keyed('text')} AS a FROM benchmark WHERE len({words('text')}) >= 3),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) >= 5)),
bg AS (SELECT item_id, k, array_to_string(a[k + 1:k + 5], ' ') AS gram FROM b, range(0, 5) r(k) WHERE len(a) - k >= 5),
h AS (SELECT doc_id, item_id, k, pos FROM dg JOIN bg USING (gram)),
z AS (SELECT h.doc_id, h.item_id, pos, len(a) AS size, len(list_filter(range(1, len(a) + 1), lambda n: pos + n <= len(w) AND w[pos + 1:pos + n] = a[1:n])) AS run FROM h JOIN d USING (doc_id) JOIN b USING (item_id) WHERE k = 0),
y AS (SELECT *, row_number() OVER o AS r, coalesce(lead(run) OVER o, 0) AS nxt FROM z WINDOW o AS (PARTITION BY doc_id, item_id ORDER BY run DESC, pos)),
f AS (SELECT doc_id, item_id, pos, greatest(nxt + 1, least(5, size)) AS n FROM y WHERE r = 1 AND run >= greatest(nxt + 1, least(5, size))),
g AS (SELECT doc_id, item_id, k, min(pos) AS pos FROM h WHERE k > 0 GROUP BY doc_id, item_id, k HAVING count(*) = 1),
e AS (SELECT doc_id, item_id, arg_min(greatest(pos - k, 0), k) AS pos FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.item_id = g.item_id) GROUP BY ALL)
SELECT doc_id, item_id, pos::BIGINT AS pos, n::BIGINT AS n FROM f UNION ALL SELECT doc_id, item_id, pos::BIGINT, 5 FROM e""",
    "expected_actual": f"""WITH {HITS}, {_STRETCH}, it AS (SELECT item_id, array_to_string({words('text')}, ' ') AS b FROM benchmark), fl AS (SELECT doc_id, array_to_string({words('text')}, ' ') AS t FROM documents),
want AS (SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id FROM hits) JOIN it USING (item_id) JOIN fl USING (doc_id) WHERE contains(t, b)), found AS (SELECT doc_id, item_id FROM st WHERE w_end - w_start >= 20),
x AS (SELECT 'missing' AS side, * FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM found) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM found EXCEPT ALL SELECT * FROM want))
SELECT side, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM x GROUP BY side""",
    "liturgical_share": f"""WITH {_LINES}, q AS (SELECT doc_id, line FROM l1 WHERE len({words('t')}) >= 3),
o AS (SELECT doc_id, line, bool_or(s::DOUBLE / (n + m - s) >= 0.55) AS formula, bool_or(s >= 0.75 * n) AS part FROM sh SEMI JOIN q USING (doc_id, line) GROUP BY doc_id, line),
k AS (SELECT doc_id, line, count(*) >= 0.85 * any_value(n) AS joined FROM lt SEMI JOIN q USING (doc_id, line) SEMI JOIN bt USING (w) GROUP BY doc_id, line)
SELECT doc_id, line, coalesce(formula, false) AS formula, coalesce(part, false) AS part, coalesce(joined, false) AS joined FROM o FULL JOIN k USING (doc_id, line) WHERE formula OR part OR joined""",
}
