"""Queries of sequence alignments: each turn of a conversation is held against the one or two that follow it, and each quoted stretch
of a document against its passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import alignment as A
from quotary.operators import spans
from quotary.plans import matching
from quotary.plans.sql import CHAIN, keyed, words
from quotary.sources.tables import table

#: Words of a part of a passage, and words around a quoted stretch that are read with it.
PART, AROUND = 12, 3


def _keys(text: str) -> F.Column:
    return F.filter(F.transform(X.words(F.col(text)), X.latin_key), lambda w: w != "")


def turn_pairs(spark: SparkSession, d: str, ahead: int = 1) -> DataFrame:
    """(conv_id, turn, text, next1..): turns with those that follow."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", *[F.lead("text", i).over(w).alias(f"next{i}") for i in range(1, ahead + 1)])
    return c.where(f"next{ahead} is not null")


def lost_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words that a turn has and the next one lacks in order, and the other way round."""
    return A.sequence_coverage(turn_pairs(spark, d), ["conv_id", "turn"], _keys("text"), _keys("next1"))


def heard_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The share of a turn's words that the next one has in order, its length beside, and whether that asks for another take."""
    h = A.heard_shares(turn_pairs(spark, d), ["conv_id", "turn"], _keys("text"), _keys("next1"))
    again = ~((F.col("said") >= 0.85) & (F.col("extra") <= 1.25))
    return h.select("conv_id", "turn", X.half_up(F.col("said"), 4).alias("said"), X.half_up(F.col("extra"), 4).alias("extra"), again.alias("again"))


def timed_words(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, anchors, times): X33, X34, W10. A turn's words take times from the next turn, a word in two fifths of a second with
    seven seconds of silence at each seventh, and where that has none from the turn after it, a word in half a second."""
    c = turn_pairs(spark, d, 2)
    start = lambda t, pace, rest: F.transform(F.sequence(F.lit(1), F.size(_keys(t)) + 1), lambda i: (i * pace + F.floor(i / F.lit(7)) * rest) / F.lit(10.0))
    shown = F.filter(X.words(F.col("text")), lambda w: X.latin_key(w) != "")
    return A.transferred_times(c, ["conv_id", "turn"], shown, _keys("text"), [(_keys("next1"), start("next1", 4, 70)), (_keys("next2"), start("next2", 5, 0))])


def anchored_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of each turn that have a time of their own, in order."""
    t = timed_words(spark, d).select("conv_id", "turn", F.posexplode("anchors").alias("at", "t")).where("t is not null")
    return t.select("conv_id", "turn", F.col("at").cast("long").alias("at"), "t")


def word_times(spark: SparkSession, d: str) -> DataFrame:
    """Times for all words of each turn that has an anchor."""
    t = timed_words(spark, d).select("conv_id", "turn", F.posexplode("times").alias("at", "t"))
    return t.select("conv_id", "turn", F.col("at").cast("long").alias("at"), X.half_up(F.col("t"), 3).alias("t"))


def recited_words(spark: SparkSession, d: str) -> DataFrame:
    """First and last word that a document says of each part of a passage, parts of 12 words, for each chained stretch with
    the 3 words around it."""
    s = spans.chain_hits(matching.hits(spark, d), ["doc_id", "item_id"]).select("doc_id", "item_id", "w_start", "w_end")
    docs = table(spark, d, "documents").select("doc_id", F.transform(X.words(F.col("text")), X.latin_key).alias("w"))
    lo = F.greatest(F.col("w_start") - AROUND, F.lit(0)).cast("int")
    k = F.transform(X.words(F.col("text")), X.latin_key)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("k") - 1) / PART).cast("int")), lambda i: F.slice("k", i * PART + 1, F.lit(PART)))
    canon = table(spark, d, "benchmark").select("item_id", k.alias("k")).where(F.size("k") > 0).select("item_id", parts.alias("parts"))
    j = s.join(docs, "doc_id").join(canon, "item_id").withColumn("said", F.filter(F.slice("w", lo + 1, F.col("w_end").cast("int") + AROUND - lo), lambda w: w != ""))
    r = j.select("doc_id", "item_id", "w_start", F.posexplode(A.recited_parts("said", "parts")).alias("part", "r"))
    return r.where("r is not null").select("doc_id", "item_id", "w_start", F.col("part").cast("long").alias("part"), "r.first", "r.last")


QUERIES = {f.__name__: f for f in (lost_runs, heard_in_order, anchored_words, word_times, recited_words)}


def lcs_sql(pairs: str) -> str:
    """CTEs lcs(id, d) and walked(id, h): rows of the table of a longest common subsequence of pairs(id, a, b), and its places."""
    same = "a[s.i + 1] = b[s.j + 1] AND a[s.i + 1] <> ''"
    skip = "d[s.i + 2][s.j + 1] >= d[s.i + 1][s.j + 2]"
    return f"""dp(id, i, r) AS (SELECT id, len(a), list_transform(range(0, len(b) + 1), lambda x: 0) FROM {pairs}
  UNION ALL SELECT dp.id, i - 1, list_transform([list_transform(range(1, len(b) + 2), lambda k: CASE WHEN k <= len(b) AND a[i] = b[k] AND a[i] <> '' THEN r[k + 1] + 1 ELSE r[k] END)], lambda c: list_transform(range(1, len(b) + 2), lambda k: list_max(c[k:])))[1]::INTEGER[] FROM dp JOIN {pairs} USING (id) WHERE i > 0),
lcs AS (SELECT id, list(r ORDER BY i) AS d FROM dp GROUP BY id),
walked AS (SELECT id, list_reduce(list_transform(range(0, len(a) + len(b) + 1), lambda x: {{'i': 0, 'j': 0, 'h': []::INTEGER[][]}}), lambda s, x:
  CASE WHEN s.i >= len(a) OR s.j >= len(b) THEN s
    WHEN {same} THEN {{'i': s.i + 1, 'j': s.j + 1, 'h': list_append(s.h, [s.i, s.j])}}
    WHEN {skip} THEN {{'i': s.i + 1, 'j': s.j, 'h': s.h}} ELSE {{'i': s.i, 'j': s.j + 1, 'h': s.h}} END).h AS h FROM {pairs} JOIN lcs USING (id))"""


def global_sql(pairs: str, name: str) -> str:
    """CTE name(id, h): places of equal words beside each other in the global alignment of pairs(id, a, b), from the back."""
    score = f"CASE WHEN a[s.i] = b[s.j] THEN {A.MATCH} ELSE {A.MISMATCH} END"
    return f"""{name}_dp(id, i, r) AS (SELECT id, 0::BIGINT, list_transform(range(0, len(b) + 1), lambda x: -x)::INTEGER[] FROM {pairs}
  UNION ALL SELECT p.id, i + 1, list_transform([list_transform(range(0, len(b) + 1), lambda k: CASE WHEN k = 0 THEN -(i + 1) ELSE greatest(r[k] + CASE WHEN a[i + 1] = b[k] THEN {A.MATCH} ELSE {A.MISMATCH} END, r[k + 1] - 1) END + k)], lambda c: list_transform(range(0, len(b) + 1), lambda k: list_max(c[:k + 1]) - k))[1]::INTEGER[] FROM {name}_dp p JOIN {pairs} USING (id) WHERE i < len(a)),
{name}_d AS (SELECT id, list(r ORDER BY i) AS d FROM {name}_dp GROUP BY id),
{name} AS (SELECT id, list_reduce(list_transform(range(0, len(a) + len(b) + 1), lambda x: {{'i': len(a)::INTEGER, 'j': len(b)::INTEGER, 'h': []::INTEGER[][]}}), lambda s, x:
  CASE WHEN s.i = 0 OR s.j = 0 THEN s
    WHEN d[s.i + 1][s.j + 1] = d[s.i][s.j] + {score} THEN {{'i': s.i - 1, 'j': s.j - 1, 'h': CASE WHEN a[s.i] = b[s.j] THEN list_append(s.h, [s.i - 1, s.j - 1]) ELSE s.h END}}
    WHEN d[s.i + 1][s.j + 1] = d[s.i][s.j + 1] - 1 THEN {{'i': s.i - 1, 'j': s.j, 'h': s.h}} ELSE {{'i': s.i, 'j': s.j - 1, 'h': s.h}} END).h AS h FROM {pairs} JOIN {name}_d USING (id))"""


_KEYS = lambda t: f"list_filter({keyed(t)}, lambda w: w <> '')"
_TURNS = f"""c AS (SELECT *, lead(text) OVER o AS next1, lead(text, 2) OVER o AS next2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
pr AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, {_KEYS('text')} AS a, {_KEYS('next1')} AS b FROM c WHERE next1 IS NOT NULL)"""
_TIMED = f"""c AS (SELECT *, conv_id * 1000 + turn AS id, lead(text) OVER o AS next1, lead(text, 2) OVER o AS next2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p1 AS (SELECT id, {_KEYS('text')} AS a, {_KEYS('next1')} AS b FROM c WHERE next2 IS NOT NULL), p2 AS (SELECT id, {_KEYS('text')} AS a, {_KEYS('next2')} AS b FROM c WHERE next2 IS NOT NULL),
{global_sql('p1', 'g1')}, {global_sql('p2', 'g2')},
h1 AS (SELECT id, x[1] AS i, ((x[2] + 1) * 4 + (x[2] + 1) // 7 * 70) / 10.0::DOUBLE AS t FROM (SELECT id, unnest(h) AS x FROM g1)), h2 AS (SELECT id, x[1] AS i, ((x[2] + 1) * 5) / 10.0::DOUBLE AS t FROM (SELECT id, unnest(h) AS x FROM g2)),
m AS (SELECT id, i, coalesce(h1.t, h2.t) AS t FROM h1 FULL JOIN h2 USING (id, i)),
v AS (SELECT id, list(i ORDER BY i) AS k, list(t ORDER BY i) AS v FROM m GROUP BY id),
l AS (SELECT *, list_reduce(list_transform(range(0, len(v) + 1), lambda x: []::INTEGER[]), lambda s, x: list_append(s, 1 + coalesce(list_max(list_transform(range(1, len(s) + 1), lambda q: CASE WHEN v[q] <= v[len(s) + 1] THEN s[q] ELSE 0 END)), 0)::INTEGER)) AS l FROM v),
f AS (SELECT *, list_reduce(list_transform(range(0, list_max(l)), lambda x: [list_max(list_filter(range(1, len(l) + 1), lambda q: l[q] = list_max(l)))]), lambda s, x: list_append(s, list_max(list_filter(range(1, s[-1]), lambda q: l[q] = l[s[-1]] - 1)))) AS f FROM l),
an AS (SELECT id, k[x]::BIGINT AS pos, v[x] AS t FROM (SELECT id, k, v, unnest(f) AS x FROM f))"""

SQL = {
    "lost_runs": f"""WITH RECURSIVE {_TURNS}, {lcs_sql('pr')},
s AS (SELECT id, 'lost' AS side, unnest(list_filter(range(0, len(a)), lambda i: NOT list_contains(list_transform(h, lambda x: x[1]), i))) AS p FROM pr JOIN walked USING (id)
  UNION ALL SELECT id, 'doubled', unnest(list_filter(range(0, len(b)), lambda i: NOT list_contains(list_transform(h, lambda x: x[2]), i))) FROM pr JOIN walked USING (id)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY id, side ORDER BY p) AS g FROM s)
SELECT conv_id, turn, side, min(p)::BIGINT AS "at", count(*)::BIGINT AS n, CASE WHEN count(*) >= 2 THEN 'fail' ELSE 'warn' END AS level FROM g JOIN pr USING (id) GROUP BY conv_id, turn, side, g""",
    "heard_in_order": f"""WITH RECURSIVE {_TURNS}, {lcs_sql('pr')}, s AS (SELECT conv_id, turn, d[1][1]::DOUBLE / greatest(1, len(a)) AS said, len(b)::DOUBLE / greatest(1, len(a)) AS extra FROM pr JOIN lcs USING (id))
SELECT conv_id, turn, floor(said * 10000 + 0.5) / 10000 AS said, floor(extra * 10000 + 0.5) / 10000 AS extra, NOT (said >= 0.85::DOUBLE AND extra <= 1.25::DOUBLE) AS again FROM s""",
    "anchored_words": f"WITH RECURSIVE {_TIMED} SELECT conv_id, turn, pos AS \"at\", t FROM an JOIN c USING (id)",
    "word_times": rf"""WITH RECURSIVE {_TIMED}, w AS (SELECT id, conv_id, turn, list_filter({words('text')}, lambda w: regexp_replace(lower(w), '[^a-z0-9à-ÿ]', '', 'g') <> '') AS w FROM c),
n AS (SELECT *, lead(pos) OVER o AS q, lead(t) OVER o AS tq, row_number() OVER o AS r FROM an WINDOW o AS (PARTITION BY id ORDER BY pos)),
sp AS (SELECT n.*, conv_id, turn, len(w) AS size, CASE WHEN tq - t > (q - pos) * 1.5 THEN list_max(list_filter(range(pos, q), lambda k: regexp_matches(w[k + 1], '[.؟!?:]$'))) END AS split FROM n JOIN w USING (id)),
o AS (SELECT *, unnest(range(CASE WHEN r = 1 THEN 0 ELSE pos END, coalesce(q, size))) AS k FROM sp)
SELECT conv_id, turn, k::BIGINT AS "at", floor(CASE WHEN k <= pos OR q IS NULL THEN t WHEN split IS NULL THEN t + (tq - t) * (k - pos) / (q - pos) WHEN k <= split THEN t + (k - pos) * 0.45::DOUBLE ELSE tq - (q - k) * 0.45::DOUBLE END * 1000 + 0.5) / 1000 AS t FROM o""",
    "recited_words": f"""WITH RECURSIVE {CHAIN}, dw AS (SELECT doc_id, {keyed('text')} AS w FROM documents), bw AS (SELECT item_id, {keyed('text')} AS a FROM benchmark),
pr AS (SELECT doc_id * 1000000000 + item_id * 100000 + w_start AS id, doc_id, item_id, w_start, a, list_filter(w[greatest(w_start - {AROUND}, 0) + 1:w_end + {AROUND}], lambda x: x <> '') AS b FROM spans JOIN dw USING (doc_id) JOIN bw USING (item_id)),
{lcs_sql('pr')},
h AS (SELECT id, x[1] // {PART} AS v, x[1] AS i, x[2] AS j FROM (SELECT id, unnest(h) AS x FROM walked)),
u AS (SELECT *, CASE WHEN lag(i) OVER o IS NULL OR (i - lag(i) OVER o) - (j - lag(j) OVER o) > {A.STRAY} THEN 1 ELSE 0 END AS cut FROM h WINDOW o AS (PARTITION BY id, v ORDER BY i)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY id, v ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM u), z AS (SELECT *, count(*) OVER (PARTITION BY id, v, run) AS n FROM r), y AS (SELECT *, max(n) OVER (PARTITION BY id, v) AS most FROM z),
k AS (SELECT id, v, min(i) AS lo, max(i) AS hi, min(j) AS jlo, max(j) AS jhi, count(*) AS n FROM y WHERE n >= 3 OR most < 3 GROUP BY id, v),
e AS (SELECT k.*, doc_id, item_id, w_start, a[v * {PART} + 1:(v + 1) * {PART}] AS p, b, lo - v * {PART} AS l, hi - v * {PART} AS g FROM k JOIN pr USING (id)),
x AS (SELECT *, coalesce(list_min(list_filter(range(1, least(l, jlo) + 1), lambda s: p[l - s + 1] = '' OR p[l - s + 1] <> b[jlo - s + 1])) - 1, least(l, jlo)) AS back,
  coalesce(list_min(list_filter(range(1, least(len(p) - g - 1, len(b) - jhi - 1) + 1), lambda s: p[g + s + 1] = '' OR p[g + s + 1] <> b[jhi + s + 1])) - 1, least(len(p) - g - 1, len(b) - jhi - 1)) AS ahead FROM e WHERE n >= least(3, (len(p) + 1) // 2))
SELECT doc_id, item_id, w_start, v::BIGINT AS part, (l - back)::BIGINT AS first, (g + ahead)::BIGINT AS last FROM x""",
}
