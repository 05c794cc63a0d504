"""Queries of term rules, containment, chains of filters, windows that overlap and distinct counts that roll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import audience, chunks, refs, terms
from quotary.operators import timing as T
from quotary.plans import matching
from quotary.plans.sql import keyed, words
from quotary.plans.timing import series
from quotary.sources.tables import table

#: What texts of any language mayn't hold, anywhere in a word.
ANYWHERE = ("password", "rights reserved", "http", "token")
#: Hours of a window, and of its overlap with the next.
LENGTH, OVERLAP = 30.0, 6.0


def rules(spark: SparkSession, d: str) -> DataFrame:
    """The passages' longer words as forbidden words of each language by their length, ANYWHERE for all."""
    w = F.explode(F.array_distinct(F.filter(F.transform(X.words(F.col("text")), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]", "")), lambda x: F.length(x) >= 6)))
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.length("term") % 4 + 1).cast("int"))
    own = table(spark, d, "benchmark").select(w.alias("term")).distinct().select(lang.alias("lang"), "term", F.lit(terms.WORD).alias("kind"), F.when(F.length("term") % 3 == 0, F.upper("term")).alias("instead"))
    return own.unionByName(spark.createDataFrame([(None, t, terms.PART, None) for t in ANYWHERE], "lang string, term string, kind string, instead string"))


def term_rules(spark: SparkSession, d: str) -> DataFrame:
    """The terms of each document's language's rules that stand in it."""
    return terms.term_findings(table(spark, d, "documents"), ["doc_id"], "lang", "text", rules(spark, d))


def letters_outside(spark: SparkSession, d: str) -> DataFrame:
    """Letters outside the script of the documents' languages."""
    found = terms.script_findings(table(spark, d, "documents"), ["doc_id", "lang"], "lang", "text")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("outside").alias("outside"))


def contained_lines(spark: SparkSession, d: str) -> DataFrame:
    """The passages' and turns' lines and words that stand in another one, wherever they begin, and in how many."""
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("t")).unionByName(table(spark, d, "conversations").select(F.explode(F.split("text", r"[.\n]")).alias("t")))
    texts = lines.select(F.trim("t").alias("t")).where("t <> ''").distinct().withColumn("key", F.md5("t"))
    return refs.contained(texts, "key", "t").groupBy("key").agg(F.count(F.lit(1)).alias("holders"))


def reference_chain(spark: SparkSession, d: str) -> DataFrame:
    """documents' lines as references through the chain of filters: every fifth by a retired method, passages as formulas."""
    line = matching.doc_lines(spark, d).where("t <> ''").select("doc_id", "line", "t", F.when(F.col("line") % 5 == 4, "scan").otherwise("ngram").alias("method"))
    kept = refs.deduplicated(line, "doc_id", "line", "t", method="method", retired="scan", formulas=table(spark, d, "benchmark"), passage="item_id", formula="text", content=F.col("t"), aloud=F.col("t").rlike("[?!]$"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").cast("long").alias("lines"))


def settled_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each line's best passage against a claim, by the line's number that passage, the next one, another one or none."""
    best = matching.best_passage(spark, d)
    n = F.col("item_id")
    named = lambda x: F.struct(F.floor(x / 8).cast("long").alias("group"), (x % 8).cast("long").alias("passage"))
    claim = F.element_at(F.array(named(n), named(n + 1), named((n * 7 + 3) % 40), F.lit(None)), (F.col("line") % 4 + 1).cast("int"))
    said = F.filter(F.transform(X.words(F.col("t")), X.latin_key), lambda w: w != "")
    rows = best.join(matching.doc_lines(spark, d), ["doc_id", "line"]).select("doc_id", "line", said.alias("said"), claim.alias("claimed"), F.when(F.col("line") % 8 != 4, named(n)).alias("matched"), "score")
    canon = table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 8).cast("long").alias("group"), (F.col("item_id") % 8).cast("long").alias("passage"), F.transform(X.words(F.col("text")), X.latin_key).alias("words"))
    got = refs.settled_claims(rows, canon, ["doc_id", "line"], "said", "score")
    return got.select("doc_id", "line", F.col("group").alias("grp"), "passage", "confidence", "verdict", "used")


def broken_off(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end with a full stop, as if it broke them off, and of whose last sentence the next turn says a quarter again."""
    return chunks.broken_off(table(spark, d, "conversations"), "conv_id", "turn", "text", r"\.$", 0.25)


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, event_type, at): hours since midnight of the first day, to three places."""
    return series(spark, d).select("user_id", "event_id", "event_type", X.half_up((F.col("us") - F.lit(1704067200000000)) / 3.6e9, 3).alias("at"))


def stitched_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each user's month heard in windows of 30 hours, 6 of them the next one's too, which each hear an event a bit later than the one
    before; stitched at the middle of the overlaps."""
    e = _hours(spark, d)
    windows = T.overlapping_windows(e.groupBy("user_id").agg((F.max("at") + 1).alias("total")), "user_id", "total", LENGTH, OVERLAP)
    spans = windows.select("user_id", "window", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))
    heard = T.in_ranges(e, spans, "user_id", "at", "a", "b", 24.0).select("user_id", "event_id", "window", (F.col("at") - F.col("a") + F.col("window") / 1024).alias("at"))
    got = T.stitched(heard, windows, "user_id")
    return got.select("user_id", "event_id", F.col("window").cast("long").alias("window"), X.half_up(F.col("at"), 3).alias("at"))


def events_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user in the two hours around each of their purchases."""
    e = _hours(spark, d)
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), (F.col("at") - 1).alias("a"), (F.col("at") + 1).alias("b"))
    return T.in_ranges(e, ranges, "user_id", "at", "a", "b", 2.0).groupBy("user_id", "purchase").agg(F.count(F.lit(1)).alias("n"))


def segment_of_word(spark: SparkSession, d: str) -> DataFrame:
    """For each click of a user the first view that is still open, a view being open as many minutes as its value."""
    e = series(spark, d)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), (F.col("us") + F.floor(F.col("value") * 60).cast("long") * 1_000_000).alias("e"))
    return T.first_ending_after(e.where("event_type = 'click'").select("user_id", "event_id", "us"), views, "user_id", "us", "e", "view_id", "segment").select("user_id", "event_id", "segment")


def rolling_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of the seven days up to each day, exactly, and whether merged sketches of the days come within 5 %."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    about = audience.distinct_over(audience.daily_sketches(e, F.col("day"), F.col("user_id")), 7)
    seen = e.select("day", "user_id").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"), "day", "user_id").select(F.date_add("day", F.col("i")).alias("day"), "user_id")
    exact = seen.groupBy("day").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(about, "day").select("day", "users", (F.abs(F.col("ids") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))


QUERIES = {f.__name__: f for f in (term_rules, letters_outside, contained_lines, reference_chain, settled_claims, broken_off, stitched_windows, events_in_ranges, segment_of_word, rolling_distinct)}

_H = "h AS (SELECT user_id, event_id, event_type, floor((epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE * 1000 + 0.5) / 1000 AS tm FROM events)"
#: Upper case in full, as the query's: DuckDB's own maps a letter to one letter.
_LONG = {c: c.upper() for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and len(c.upper()) > 1}
_UPPER = f"array_to_string(list_transform(string_split(term, ''), lambda x: coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in _LONG.items())}}}[x], upper(x))), '')"
SQL = {
    "term_rules": f"""WITH t AS (SELECT DISTINCT unnest(list_filter(list_transform({words('text')}, lambda x: regexp_replace(lower(x), '[^\\p{{L}}]', '', 'g')), lambda x: length(x) >= 6)) AS term FROM benchmark),
r AS (SELECT ['de', 'en', 'es', 'fr'][length(term) % 4 + 1] AS lang, term, CASE WHEN length(term) % 3 = 0 THEN {_UPPER} END AS instead FROM t),
w AS (SELECT doc_id, lang, term, min(i) AS i, count(*) AS n FROM (SELECT doc_id, lang, i, us[i] AS term FROM (SELECT doc_id, lang, us, unnest(range(1, len(us) + 1)) AS i FROM (SELECT doc_id, lang, string_split_regex(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS us FROM documents))) GROUP BY ALL),
f AS (SELECT w.doc_id, term, instead, n, length(regexp_extract(lower(text), '(?s)^(|.*?[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || term || '([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', 1)) AS first FROM w JOIN r USING (lang, term) JOIN documents d ON d.doc_id = w.doc_id),
p AS (SELECT doc_id, term, NULL AS instead, (length(text) - length(replace(lower(text), term, ''))) // length(term) AS n, instr(lower(text), term) - 1 AS first FROM documents, (SELECT unnest({list(ANYWHERE)}) AS term) WHERE contains(lower(text), term))
SELECT doc_id, term, instead, n::BIGINT AS n, first::BIGINT AS first FROM f UNION ALL SELECT doc_id, term, instead, n::BIGINT, first::BIGINT FROM p""",
    "letters_outside": "SELECT lang, count(*)::BIGINT AS texts, sum(length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '\\p{Latin}', '', 'g')))::BIGINT AS outside FROM documents GROUP BY lang",
    "contained_lines": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark UNION ALL SELECT unnest(string_split_regex(text, '[.\\n]')) FROM conversations), x AS (SELECT DISTINCT trim(t) AS t FROM l WHERE trim(t) <> '')
SELECT md5(a.t) AS key, count(*)::BIGINT AS holders FROM x a JOIN x b ON a.t <> b.t AND length(a.t) < length(b.t) AND contains(b.t, a.t) GROUP BY 1""",
    "reference_chain": f"""WITH RECURSIVE {matching._LINES}, q AS (SELECT DISTINCT doc_id, line FROM sh WHERE s::DOUBLE / (n + m - s) >= 0.55),
g AS (SELECT doc_id, line, t FROM l1 ANTI JOIN q USING (doc_id, line) WHERE t <> '' AND line % 5 <> 4 AND (len({words('t')}) >= 4 OR (regexp_matches(t, '[?!]$') AND len({words('t')}) >= 2))),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM g),
k AS (SELECT doc_id, line, r, [t] AS kept, true AS ok FROM n WHERE r = 1
  UNION ALL SELECT n.doc_id, n.line, n.r, CASE WHEN len(list_filter(kept, lambda x: contains(x, n.t) OR contains(n.t, x))) > 0 THEN kept ELSE list_append(kept, n.t) END, len(list_filter(kept, lambda x: contains(x, n.t) OR contains(n.t, x))) = 0 FROM k JOIN n ON n.doc_id = k.doc_id AND n.r = k.r + 1)
SELECT doc_id, count(*)::BIGINT AS n, sum(line)::BIGINT AS lines FROM k WHERE ok GROUP BY doc_id""",
    "settled_claims": f"""WITH {matching._BEST}, x AS (SELECT b.doc_id, b.line, list_filter({keyed('t')}, lambda w: w <> '') AS w, score, item_id, CASE b.line % 4 WHEN 0 THEN item_id WHEN 1 THEN item_id + 1 WHEN 2 THEN (item_id * 7 + 3) % 40 END AS c, CASE WHEN b.line % 8 <> 4 THEN item_id END AS m FROM best b JOIN l1 USING (doc_id, line)),
i AS (SELECT item_id, {keyed('text')} AS a FROM benchmark), y AS (SELECT x.*, coalesce(p.a, []) AS pc, coalesce(q.a, []) AS pm FROM x LEFT JOIN i p ON p.item_id = x.c LEFT JOIN i q ON q.item_id = x.m),
z AS (SELECT *, c IS NOT NULL AND m IS NOT NULL AND c <> m AND CASE WHEN c // 8 = m // 8 AND abs(c - m) = 1 THEN len(list_filter(w[:3], lambda v: list_contains(pm, v))) > len(list_filter(w[:3], lambda v: list_contains(pc, v)))
  ELSE len(list_filter(w, lambda v: list_contains(pm, v)))::DOUBLE / greatest(1, len(w)) > len(list_filter(w, lambda v: list_contains(pc, v)))::DOUBLE / greatest(1, len(w)) + 0.15::DOUBLE END AS better FROM y),
u AS (SELECT *, CASE WHEN c IS NOT NULL AND NOT better THEN c ELSE m END AS chosen FROM z)
SELECT doc_id, line, chosen // 8 AS grp, chosen % 8 AS passage, floor(CASE WHEN c <> m THEN 0.75 WHEN c = m THEN greatest(0.95, score) WHEN c IS NOT NULL THEN 0.85 WHEN m IS NOT NULL THEN score ELSE 0 END::DOUBLE * 100 + 0.5) / 100 AS confidence,
CASE WHEN c <> m THEN 'differ' WHEN c = m THEN 'agree' WHEN c IS NOT NULL THEN 'claim only' WHEN m IS NOT NULL THEN 'match only' ELSE 'no match' END AS verdict, CASE WHEN c IS NOT NULL AND NOT better THEN 'claim' WHEN m IS NOT NULL THEN 'match' ELSE 'none' END AS used FROM u""",
    "broken_off": f"""WITH t AS (SELECT conv_id, turn, trim(text) AS t, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), s AS (SELECT *, regexp_replace(string_split_regex(t, '[.،؟!:؛]\\s')[-1], '\\.$', '') AS last FROM t WHERE nxt IS NOT NULL AND regexp_matches(t, '\\.$')),
k AS (SELECT conv_id, turn, {keyed('last')} AS k, {keyed('nxt')} AS x FROM s), w AS (SELECT conv_id, turn, k[:len(k) - 1] AS w, x[:len(k) + 3] AS h FROM k WHERE len(k) > 0), n AS (SELECT conv_id, turn, len(w) AS size, len(list_filter(w, lambda v: list_contains(h, v))) AS n FROM w)
SELECT conv_id, turn, n::BIGINT AS n FROM n WHERE size >= 2 AND n >= greatest(2.0, size * 0.25::DOUBLE)""",
    "stitched_windows": f"""WITH {_H}, t AS (SELECT user_id, greatest(ceil((max(tm) + 1 - {OVERLAP}) / {LENGTH - OVERLAP}) - 1, 0)::INTEGER AS last FROM h GROUP BY user_id), w AS (SELECT user_id, last, unnest(range(0, last + 1)) AS w FROM t),
s AS (SELECT h.user_id, event_id, w, tm + w / 1024::DOUBLE AS at2, last, w * {LENGTH - OVERLAP} AS start FROM h JOIN w ON h.user_id = w.user_id AND tm >= w * {LENGTH - OVERLAP} AND tm < w * {LENGTH - OVERLAP} + {LENGTH})
SELECT user_id, event_id, w::BIGINT AS "window", floor(at2 * 1000 + 0.5) / 1000 AS "at" FROM s WHERE (w = 0 OR at2 >= start + {OVERLAP / 2}) AND (w = last OR at2 < start + {LENGTH - OVERLAP / 2})""",
    "events_in_ranges": f"WITH {_H} SELECT p.user_id, p.event_id AS purchase, count(*)::BIGINT AS n FROM h p JOIN h e ON e.user_id = p.user_id AND e.tm >= p.tm - 1 AND e.tm < p.tm + 1 WHERE p.event_type = 'purchase' GROUP BY ALL",
    "segment_of_word": "WITH v AS (SELECT user_id, event_id AS view_id, epoch_us(ts) + floor(value * 60)::BIGINT * 1000000 AS e FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click') SELECT c.user_id, c.event_id, arg_min(view_id, (e, view_id)) AS segment FROM c LEFT JOIN v ON v.user_id = c.user_id AND e > us GROUP BY ALL",
    "rolling_distinct": "WITH e AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), d AS (SELECT DISTINCT day FROM e) SELECT d.day, count(DISTINCT user_id)::BIGINT AS users, true AS close FROM d JOIN e ON e.day BETWEEN d.day - 6 AND d.day GROUP BY d.day",
}
