"""Queries of the rules on names, numbers, wordings, pairs, takes and of what belongs to a track or a number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import cards as C
from quotary.functions import lang as L
from quotary.functions import names as N
from quotary.functions import text as X
from quotary.operators import assembly as A
from quotary.operators import audience as U
from quotary.plans.sql import keyed, words
from quotary.sources.tables import table

#: Latin letters that stand for letters of the script, so that its keys have something to fold.
LETTERS, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
EXTRA = "آىةؤئءٱأإيو"
AGENTS = ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Version/17.0 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (compatible; Googlebot/2.1)", "Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the next one of their conversation."""
    return table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))


def script_keys(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the canon's keys, its letters written in the script."""
    t = F.translate(F.translate(F.lower("text"), LETTERS, SCRIPT), "éèêàçùâîôûëïü", EXTRA + "يو")
    b = table(spark, d, "benchmark").select("item_id", t.alias("t"))
    return b.select("item_id", *[F.md5(f(F.col("t"))).alias(n) for n, f in (("light", X.normalize_script), ("letters", X.letters_key))], F.length(X.deep_key(F.col("t"))).cast("long").alias("n_deep"), F.length(X.spelling_key(F.col("t"))).cast("long").alias("n_spelled"))


def loose_words(spark: SparkSession, d: str) -> DataFrame:
    """words of the loose key of each document, composed first."""
    w = L.loose_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(w)).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def clitics(spark: SparkSession, d: str) -> DataFrame:
    """The canon's words without their prefixes, those of three letters or more that last 0.15 seconds."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(L.keys(F.col("text"), X.latin_key)).alias("w"))
    bare = L.strip_clitic(F.col("w"), L.LATIN)
    return w.where((F.length(bare) >= 3) & (F.length("w") * 0.03 >= 0.15)).groupBy(bare.alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("forms"))


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    """neighbouring turns whose first three words, as names, share a key, and their plain forms."""
    name = lambda t: F.array_join(F.slice(X.words(F.col(t)), 1, 3), " ")
    c = turns(spark, d).where("nxt is not null").select("conv_id", "turn", name("text").alias("a"), name("nxt").alias("b"))
    return c.select("conv_id", "turn", N.same_name(F.col("a"), F.col("b")).alias("same"), F.size(N.name_keys(F.col("a"))).cast("long").alias("n"), N.plain_name(F.concat_ws(" bin ", "a", "b")).alias("plain"))


def shown_numbers(spark: SparkSession, d: str) -> DataFrame:
    """numbers of line items as they are shown, those of one collection with letters."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("n"), F.concat(F.col("l_partkey"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit(".0"), F.col("l_linenumber"))).otherwise("")).alias("o"), F.when(F.col("l_suppkey") % 2 == 0, "ara-muslim").otherwise("ara-nasai").alias("c"))
    return i.groupBy("c", N.shown_number(F.col("c"), F.col("n"), F.col("o")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


def collection_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Names of collections with a supplier's, to slugs, names and ranks."""
    given = F.array(*[F.lit(x) for x in (*N.DISPLAY.values(), "abi dawud", "Ibn-e-Majah")])
    s = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(" ", F.element_at(given, (F.col("s_suppkey") % len(N.DISPLAY) + 1).cast("int")), "s_name").alias("name"))
    slug = N.collection_slug(F.col("name"))
    return s.select("s_suppkey", slug.alias("slug"), N.slug_display(slug).alias("shown"), N.collection_rank(slug).cast("long").alias("rank"))


def place_slugs(spark: SparkSession, d: str) -> DataFrame:
    """F32: slugs of places named by a document's first words."""
    name = F.concat(F.lit("Masjid "), F.array_join(F.slice(X.words(F.col("text")), 1, 8), " "))
    return table(spark, d, "documents").select("doc_id", L.place_slug(name).alias("slug"))


def shown_texts(spark: SparkSession, d: str) -> DataFrame:
    """texts of the canon as they are shown, and as an edition has them."""
    t = F.concat(F.lit("📖 1:2\n\n❝ "), F.col("text"), F.lit("\n\n \n\n📚 end"))
    e = F.concat(F.lit("heading "), F.col("item_id"), F.lit(". "), F.col("text"), F.when(F.col("item_id") % 2 == 0, " [3] and a note").otherwise(""))
    return table(spark, d, "benchmark").select("item_id", C.shown_text(t).alias("shown"), C.edition_text(e, F.col("item_id"), "eng").alias("edition"))


def paired_phrases(spark: SparkSession, d: str) -> DataFrame:
    """ends of lines, by words and by characters, as pairs of phrases: valid if both rise to the last."""
    sizes = F.filter(F.transform(F.split("text", "\n"), lambda t: F.array(F.size(X.words(t)), F.length(t))), lambda p: p[1] > 0)
    ends = F.aggregate(sizes, F.array().cast("array<array<int>>"), lambda a, x: F.concat(a, F.array(F.array(F.coalesce(F.get(a, F.size(a) - 1)[0], F.lit(-1)) + x[0], F.coalesce(F.get(a, F.size(a) - 1)[1], F.lit(-1)) + x[1]))))
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array(ends)).alias("p"), F.size(X.words(F.col("text"))).alias("a"), F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("b"))
    return t.select("doc_id", C.valid_pairs(F.col("p"), F.col("a"), F.col("b")).alias("valid"))


def accepted_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """excerpts of each passage, its third to twentieth word in quote marks, whose place is near those of its first half."""
    w = X.words(F.col("text"))
    x = F.concat(F.lit("“"), F.array_join(F.slice(w, 3, 18), " "), F.lit("”"))
    t = table(spark, d, "benchmark").select("item_id", F.array_join(w, " ").alias("t"), x.alias("x"))
    return t.select("item_id", C.accepted_excerpt(F.col("x"), F.col("t"), F.lit(0.0), F.lit(0.5)).isNotNull().alias("ok"))


def takes(spark: SparkSession, d: str) -> DataFrame:
    """events as takes: their score, whether another is wanted, and a property with a default."""
    props = F.from_json("props", "map<string,bigint>")
    e = table(spark, d, "events").select("event_id", "event_type", F.explode(F.array(props)).alias("p"), F.round(F.col("value") / 100, 4).alias("said")).withColumn("k", C.with_default(F.col("p"), F.lit("k"), F.lit(0)))
    e = e.select("event_type", (F.col("k") % 4).cast("int").alias("take"), F.col("k").cast("int").alias("n"), "said", (0.9 + F.col("k") / 200).alias("extra"), C.with_default(F.col("p"), F.lit("none"), F.lit(7)).alias("none"))
    return e.groupBy("event_type").agg(F.count_if(C.take_again(F.col("take"), F.col("n"), F.col("said"), F.col("extra"), F.when(F.col("take") > 1, F.lit(0.3)))).alias("again"), F.round(F.sum(C.take_score(F.col("said"), F.col("extra"))), 3).alias("score"), F.sum("none").alias("none"))


def person_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose next one adds a first person or names, or drops names and numbers."""
    c = turns(spark, d).where("nxt is not null")
    return c.select("conv_id", "turn", F.size(C.person_shift(F.col("text"), F.col("nxt"))).cast("long").alias("persons"), F.size(C.added_names(F.col("nxt"), F.col("text"))).cast("long").alias("added"), F.size(C.dropped_words(F.col("text"), F.col("nxt"))).cast("long").alias("dropped"))


def removed_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that a turn has and the next one lacks, as multisets, and whether the turn before has most of them."""
    c = turns(spark, d).withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    return c.select("conv_id", "turn", F.size(C.removed_words(F.col("text"), F.col("nxt"))).cast("long").alias("n"), C.removes_neighbour(F.col("text"), F.col("nxt"), F.array_compact(F.array("prev"))).alias("neighbour"))


def guarded_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The turn two on as a correction, with all guards."""
    c = table(spark, d, "conversations").withColumn("fix", F.lead("text", 2).over(Window.partitionBy("conv_id").orderBy("turn")))
    return A.neighbour_guard(c, "conv_id", "turn", "text", "fix").select("conv_id", "turn", "verdict")


def terms_without_source(spark: SparkSession, d: str) -> DataFrame:
    """P20: turns with a term that the turn before, its source, gives no reason for."""
    c = turns(spark, d).where("nxt is not null")
    return c.where(C.term_without_source(F.lower("nxt"), r"\b(there|that|qui|der)\b", F.lower("text"), r"\b(there|that|qui|der)\b")).select("conv_id", "turn")


def newer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events of the newer schema alone: those with a property, by type."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.where(F.when(F.col("k") % 4 != 0, F.col("k")).isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def increasing_times(spark: SparkSession, d: str) -> DataFrame:
    """Values of each user's events made strictly increasing, by the weight of their property."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return A.strictly_increasing(e, "user_id", "event_id", "value", "k", "t").select("user_id", "event_id", "t")


def made_up_speech(spark: SparkSession, d: str) -> DataFrame:
    """Views of a user as words, other events as frames: the gap between words with the most sound."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = e.where("event_type = 'view'").select("user_id", F.col("t").alias("start"), (F.col("t") + 60).alias("end"))
    f = e.where("event_type <> 'view'").select("user_id", "t", (F.col("value") * 10).alias("level"))
    return A.made_up_speech(w, f, "user_id", gap=3600.0, least=1.0, frame=0.5)


def matched_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns and those of them that another version has, in order."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    o = c.where("turn % 3 <> 1").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("turn"), "text")
    return A.matched_blocks(c, o, "conv_id", "turn", "text")


def fresh_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks by role whose heads are those of the turns as they are; some were made before a change."""
    c = table(spark, d, "conversations")
    head = F.array_join(F.slice(X.words(F.col("text")), 1, F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), 5).otherwise(6)), " ")
    return A.fresh_tracks(c.select("conv_id", "turn", F.col("role").alias("track"), head.alias("head")), c, "conv_id", "track", "turn", "head", "text")


def numbered_matches(spark: SparkSession, d: str) -> DataFrame:
    """Passages looked up by a number that several have, else in their whole collection, by word pairs."""
    pairs = F.array_distinct(X.ngrams(L.keys(F.col("text"), X.latin_key), 2))
    b = table(spark, d, "benchmark").select("item_id", F.explode(F.array(pairs)).alias("pairs"), F.concat(F.lit("c"), F.col("item_id") % 2).alias("collection"))
    asked = b.select("item_id", "collection", "pairs", F.when(F.col("item_id") % 3 == 0, F.lit("none")).otherwise((F.col("item_id") % 10).cast("string")).alias("number"))
    known = b.select(F.col("item_id").alias("id"), "collection", "pairs", (F.col("item_id") % 10).cast("string").alias("number"), F.concat(F.col("item_id") + 1, F.lit(".01")).alias("other"))
    return A.same_number(asked, known, "item_id")


def agents(spark: SparkSession, d: str) -> DataFrame:
    """Events by the class of their user agent."""
    ua = F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("user_id") % len(AGENTS) + 1).cast("int"))
    e = U.classify_agent(table(spark, d, "events").select(ua.alias("ua")), "ua")
    return e.groupBy("bot", "os", "device", "browser").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        script_keys, loose_words, clitics, shared_names, shown_numbers, collection_slugs, place_slugs, shown_texts, paired_phrases, accepted_excerpts, takes, person_shifts, removed_words, guarded_reviews, terms_without_source,
        newer_rows, increasing_times, made_up_speech, matched_blocks, fresh_tracks, numbered_matches, agents,
    )
}

_T = "c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)"
_ONCE = lambda x: reduce(lambda t, c: f"regexp_replace({t}, '{c}{c}+', '{c}', 'g')", "bcdfghjklmnpqrstvxz", x)
_NAME = lambda t: f"list_filter(string_split_regex(regexp_replace(lower({t}), '[^a-z\\s-]', '', 'g'), '[\\s-]+'), lambda w: w <> '' AND w NOT IN {N.NAME_STOP})"
_BARE = "translate(regexp_replace(w, '^al', ''), 'oe', 'ui')"
_NKEYS = lambda t: f"list_distinct(list_filter(list_transform({_NAME(t)}, lambda w: left({_BARE}, 1) || regexp_replace({_ONCE(f'''regexp_replace({_BARE}[2:], '[aeiouyw]', '', 'g')''')}, '(.)h$', '\\1')), lambda k: length(k) >= 2))"
_SKEL = lambda w: f"regexp_replace({_ONCE(f'''regexp_replace(translate(regexp_replace(regexp_replace(lower({w}), '^al-', ''), '[^a-z]', '', 'g'), 'cq', 'kk'), '[aeiouyw]', '', 'g')''')}, 'h$', '')"
_STEP = lambda t, steps: reduce(lambda x, s: f"regexp_replace({x}, '{s[0]}', '{s[1]}', 'g')", [(a.replace("'", "''"), b) for a, b in steps], t)
_LETTERED = f"translate(translate(lower(text), '{LETTERS}', '{SCRIPT}'), 'éèêàçùâîôûëïü', '{EXTRA}يو')"
_VOC = lambda t: f"regexp_replace(regexp_replace(regexp_replace({t}, '۞\\s*', '', 'g'), '(^|\\s)يَ?ـ?ٰٓ?(\\S)', '\\1يا \\2', 'g'), 'ىٰ([ٓٔ]?[ء-ي])', 'ا\\1', 'g')"
_FOLD = lambda t: f"regexp_replace({_STEP(t, X.FOLD_STEPS[:3])}, '(^|\\s)الل([^ه]|$)', '\\1ال\\2', 'g')"
_TAIL = lambda t: f"trim(regexp_replace(translate({t}, 'ىة', 'يه'), '\\s+', ' ', 'g'))"
_LIGHT = lambda t: f"trim({_STEP(t, X.SCRIPT_STEPS)})"
_PLAIN = lambda t, n: f"regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]{{{n},}}')"
_SQL_LIST = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
SQL = {
    "script_keys": f"WITH b AS (SELECT item_id, {_LETTERED} AS t FROM benchmark) SELECT item_id, md5({_LIGHT('t')}) AS light, md5(regexp_replace({_LIGHT('t')}, '[^ء-ي]', '', 'g')) AS letters, length({_TAIL(f'''regexp_replace({_FOLD(_LIGHT(_VOC('t')))}, 'ا', '', 'g')''')})::BIGINT AS n_deep, length({_TAIL(_FOLD(_LIGHT(f'''regexp_replace({_VOC('t')}, 'ٰ', '', 'g')''')))})::BIGINT AS n_spelled FROM b",
    "loose_words": f"WITH d AS (SELECT doc_id, lower({_STEP('nfc_normalize(text)', L.LOOSE_STEPS)}) AS t FROM documents), w AS (SELECT doc_id, {words('t')} AS w FROM d) SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS digest FROM w",
    "clitics": f"WITH w AS (SELECT unnest({keyed('text')}) AS w FROM benchmark), b AS (SELECT w, regexp_replace(w, '^(?:re|un|an)(...)', '\\1') AS bare FROM w) SELECT bare, count(*)::BIGINT AS n, count(DISTINCT w)::BIGINT AS forms FROM b WHERE length(bare) >= 3 AND length(w) * 0.03::DOUBLE >= 0.15::DOUBLE GROUP BY bare",
    "shared_names": f"WITH {_T}, n AS (SELECT conv_id, turn, array_to_string(({words('text')})[1:3], ' ') AS a, array_to_string(({words('nxt')})[1:3], ' ') AS b FROM c WHERE nxt IS NOT NULL), k AS (SELECT *, {_NKEYS('a')} AS ka, {_NKEYS('b')} AS kb FROM n) SELECT conv_id, turn, list_has_any(ka, kb) AS same, len(ka)::BIGINT AS n, trim(regexp_replace(regexp_replace(translate(lower(a || ' bin ' || b), '`''’ʿʾ', ''), '\\b(?:b\\.|bin)\\s', 'ibn ', 'g'), '\\s+', ' ', 'g')) AS plain FROM k",
    "shown_numbers": "WITH i AS (SELECT l_orderkey::VARCHAR AS n, l_partkey || CASE WHEN l_linenumber > 1 THEN '.0' || l_linenumber ELSE '' END AS o, CASE WHEN l_suppkey % 2 = 0 THEN 'ara-muslim' ELSE 'ara-nasai' END AS c, l_linenumber, l_partkey FROM lineitem) SELECT c, CASE WHEN c = 'ara-nasai' THEN n WHEN l_linenumber > 1 THEN l_partkey || chr(96 + l_linenumber::INT) ELSE o END AS number, count(*)::BIGINT AS n FROM i GROUP BY 1, 2",
    "collection_slugs": f"WITH s AS (SELECT s_suppkey, lower({[*N.DISPLAY.values()]}[s_suppkey % {len(N.DISPLAY)} + 1] || ' ' || s_name) AS name FROM supplier), g AS (SELECT s_suppkey, CASE {' '.join(f'''WHEN regexp_matches(name, '{p}') THEN '{s}' ''' for p, s in N.SLUGS)} END AS slug FROM s) SELECT s_suppkey, slug, CASE slug {' '.join(f'''WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}' ''' for k, v in N.DISPLAY.items())} ELSE slug END AS shown, coalesce(list_position({list(N.RANK)}, slug), {len(N.RANK) + 1})::BIGINT AS rank FROM g".replace('"Sunan an-Nasa\'i"', "'Sunan an-Nasa''i'"),
    "place_slugs": f"WITH d AS (SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents('Masjid ' || array_to_string(({words('text')})[1:8], ' ')), '[^\\x00-\\x7f]', '', 'g')), '\\b(masjid|mosque|jami|jamia)\\b', '', 'g') AS t FROM documents) SELECT doc_id, left(regexp_replace(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 30) AS slug FROM d",
    "shown_texts": "SELECT item_id, trim(text) AS shown, CASE WHEN length(text) + CASE WHEN item_id % 2 = 0 THEN 15 ELSE 0 END > 40 - length(item_id::VARCHAR) THEN text ELSE 'heading ' || item_id || '. ' || text END AS edition FROM benchmark",
    "paired_phrases": f"""WITH p AS (SELECT doc_id, i, len({words('ls[i]')}) AS w, length(ls[i]) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
q AS (SELECT doc_id, i, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS a FROM p WHERE n > 0),
g AS (SELECT doc_id, bool_and((k = 1 OR w > 0) AND a >= 0) AS v FROM q GROUP BY doc_id) SELECT doc_id, coalesce(v, false) AS valid FROM documents LEFT JOIN g USING (doc_id)""",
    "accepted_excerpts": f"WITH e AS (SELECT item_id, len({words('text')}) AS n FROM benchmark) SELECT item_id, n > 2 AND 2.0 / n <= 0.25 AND abs(least(20, n)::DOUBLE / n - 0.5) <= 0.25 AS ok FROM e",
    "takes": """WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::INT AS k, round(value / 100, 4) AS said FROM events), t AS (SELECT *, k % 4 AS take, 0.9::DOUBLE + k / 200.0::DOUBLE AS extra FROM e), s AS (SELECT *, said - greatest(0.0::DOUBLE, extra - 1.15::DOUBLE) AS score FROM t)
SELECT event_type, count(*) FILTER (WHERE take < 3 AND NOT (said >= 0.85 AND extra <= 1.25) AND k >= 40 AND NOT coalesce(score <= CASE WHEN take > 1 THEN 0.3::DOUBLE END + 0.02::DOUBLE, false))::BIGINT AS again, round(sum(score), 3) AS score, (7 * count(*))::BIGINT AS "none" FROM s GROUP BY event_type""",
    "person_shifts": f"""WITH {_T}, p AS (SELECT conv_id, turn, text, nxt, {words('text')} AS a, {words('nxt')} AS b FROM c WHERE nxt IS NOT NULL),
i AS (SELECT *, [x for x in list_transform(range(2, len(a) + 1), lambda i: CASE WHEN NOT regexp_matches(a[i - 1], '[.!?:;"''“‘(]$') AND NOT regexp_matches(a[i], '^["''“‘(]') THEN regexp_replace(regexp_replace(a[i], '^[^A-Za-z]+|[^A-Za-z'']+$', '', 'g'), '''s$', '') END) if regexp_matches(x, '^[A-Z]')] AS an,
 [x for x in list_transform(range(2, len(b) + 1), lambda i: CASE WHEN NOT regexp_matches(b[i - 1], '[.!?:;"''“‘(]$') AND NOT regexp_matches(b[i], '^["''“‘(]') THEN regexp_replace(regexp_replace(b[i], '^[^A-Za-z]+|[^A-Za-z'']+$', '', 'g'), '''s$', '') END) if regexp_matches(x, '^[A-Z]')] AS bn,
 list_transform(string_split_regex(text, '[^A-Za-z''-]+'), lambda w: {_SKEL('w')}) AS sa, list_transform(string_split_regex(nxt, '[^A-Za-z''-]+'), lambda w: {_SKEL('w')}) AS sb, list_filter(string_split_regex(lower(nxt), '[^a-z0-9]+'), lambda w: w <> '') AS lb,
 list_transform(a, lambda t: regexp_replace(regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9'']+$', '', 'g'), '''s$', '')) AS tk FROM p)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b(?:we|us|our|ours|ourselves)\\b') THEN len(list_filter(list_distinct(regexp_extract_all(nxt, '\\b(?:I|me|my|mine|myself)\\b')), lambda x: NOT list_contains(regexp_extract_all(text, '\\b(?:I|me|my|mine|myself)\\b'), x))) ELSE 0 END::BIGINT AS persons,
len(list_filter(bn, lambda w: lower(w) NOT IN {_SQL_LIST(C.CAPITAL_STOP)} AND length({_SKEL('w')}) >= 2 AND NOT list_contains(sa, {_SKEL('w')})))::BIGINT AS added,
(len(list_filter(tk, lambda w: (lower(w) IN {_SQL_LIST(C.NUMBER_WORDS)} OR regexp_matches(w, '^[0-9]+$')) AND NOT list_contains(lb, lower(w)))) + len(list_filter(an, lambda w: lower(w) NOT IN {_SQL_LIST(C.DROP_STOP)} AND lower(w) NOT IN {_SQL_LIST(C.NUMBER_WORDS)} AND CASE WHEN length({_SKEL('w')}) >= 3 THEN NOT list_contains(sb, {_SKEL('w')}) ELSE len(list_filter(lb, lambda v: left(v, 4) = left(lower(w), 4))) = 0 END)))::BIGINT AS dropped FROM i""",
    "removed_words": f"""WITH {_T}, p AS (SELECT conv_id, turn, prev, {_PLAIN('text', 3)} AS a, {_PLAIN('nxt', 3)} AS b, {_PLAIN('prev', 3)} AS p FROM c WHERE nxt IS NOT NULL),
q AS (SELECT *, list_transform(list_filter(range(1, len(a) + 1), lambda i: len(list_filter(a[1:i], lambda v: v = a[i])) > len(list_filter(b, lambda v: v = a[i]))), lambda i: a[i]) AS cut FROM p)
SELECT conv_id, turn, len(cut)::BIGINT AS n, len(b) > 0 AND len(cut) >= 5 AND prev IS NOT NULL AND len(list_filter(cut, lambda w: list_contains(p, w))) >= 0.8 * len(cut) AS neighbour FROM q""",
    "terms_without_source": f"WITH {_T} SELECT conv_id, turn FROM c WHERE nxt IS NOT NULL AND regexp_matches(lower(nxt), '\\b(there|that|qui|der)\\b') AND NOT regexp_matches(lower(text), '\\b(there|that|qui|der)\\b')",
    "newer_rows": "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE json_extract_string(props, '$.k')::BIGINT % 4 <> 0 GROUP BY event_type",
    "increasing_times": """WITH e AS (SELECT user_id, event_id, value, greatest(1, json_extract_string(props, '$.k')::BIGINT) AS k, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS good FROM events),
r AS (SELECT *, sum(good::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), g AS (SELECT user_id, run, value AS t0, lead(value) OVER (PARTITION BY user_id ORDER BY run) AS t1 FROM r WHERE good),
a AS (SELECT r.*, t0, coalesce(t1, t0 + count(*) OVER w) AS t1, sum(k) OVER w AS every, coalesce(sum(k) OVER (PARTITION BY r.user_id, r.run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc FROM r JOIN g USING (user_id, run) WINDOW w AS (PARTITION BY r.user_id, r.run))
SELECT user_id, event_id, CASE WHEN good THEN value ELSE floor((t0 + (t1 - t0) * acc / every) * 10 + 0.5) / 10 END AS t FROM a""",
    "made_up_speech": """WITH e AS (SELECT user_id, event_type, value * 10 AS level, epoch_us(ts) / 1e6 AS t FROM events), w AS (SELECT user_id, t + 60 AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM e WHERE event_type = 'view'), g AS (SELECT * FROM w WHERE b - a >= 3600),
f AS (SELECT * FROM e WHERE event_type <> 'view'), l AS (SELECT user_id, level / 10 AS least FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM f WHERE level > 200) WHERE r = n // 2 + 1),
v AS (SELECT g.user_id, a, b, round(count(*) * 0.5, 2) AS seconds FROM g JOIN f ON f.user_id = g.user_id AND f.t >= a AND f.t < b JOIN l ON l.user_id = g.user_id WHERE level > least GROUP BY ALL HAVING round(count(*) * 0.5, 2) >= 1)
SELECT user_id, a AS start, b AS "end", seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, a) AS r FROM v) WHERE r = 1""",
    "matched_blocks": """WITH b AS (SELECT conv_id, list(md5(text) ORDER BY turn) AS b FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id), a AS (SELECT conv_id, list({'n': turn, 'h': md5(text)} ORDER BY turn) AS a FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(a, lambda s, x: CASE WHEN coalesce(list_position(b[s.j + 1:s.j + 4], x.h), 0) > 0 THEN {'j': s.j + list_position(b[s.j + 1:s.j + 4], x.h), 'o': list_append(s.o, {'n': x.n, 'o': (s.j + list_position(b[s.j + 1:s.j + 4], x.h) - 1)::BIGINT})} ELSE s END, {'j': 0::BIGINT, 'o': []::STRUCT(n BIGINT, o BIGINT)[]}) AS s FROM a JOIN b USING (conv_id))
SELECT conv_id, m.n AS turn, m.o AS other FROM (SELECT conv_id, unnest(s.o) AS m FROM f)""",
    "fresh_tracks": f"WITH c AS (SELECT conv_id, role, turn, {words('text')} AS w FROM conversations) SELECT conv_id, role AS track FROM c GROUP BY conv_id, role HAVING bool_and(NOT (conv_id % 3 = 0 AND turn = 1) OR len(w) <= 5)",
    "numbered_matches": f"""WITH b AS (SELECT item_id, item_id % 2 AS c, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM (SELECT item_id, {keyed('text')} AS w FROM benchmark)),
n AS (SELECT a.item_id, k.item_id AS id FROM b a JOIN b k ON a.c = k.c AND a.item_id % 3 <> 0 AND (a.item_id % 10 = k.item_id % 10 OR a.item_id % 10 = k.item_id + 1)),
r AS (SELECT * FROM n UNION SELECT a.item_id, k.item_id FROM b a JOIN b k ON a.c = k.c AND list_has_any(a.p, k.p) WHERE a.item_id NOT IN (SELECT item_id FROM n)),
s AS (SELECT r.item_id, id, len(list_intersect(a.p, k.p))::DOUBLE / greatest(len(a.p), 1) AS score FROM r JOIN b a ON a.item_id = r.item_id JOIN b k ON k.item_id = id)
SELECT item_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.5) WHERE r = 1""",
    "agents": "WITH e AS (SELECT user_id % 4 AS a FROM events) SELECT a = 2 AS bot, CASE a WHEN 0 THEN 'iOS' WHEN 1 THEN 'Windows' WHEN 3 THEN 'Android' ELSE 'Other' END AS os, CASE a WHEN 0 THEN 'Phone' WHEN 3 THEN 'Phone' ELSE 'Computer' END AS device, CASE a WHEN 0 THEN 'Safari' WHEN 2 THEN 'Other' ELSE 'Chrome' END AS browser, count(*)::BIGINT AS n FROM e GROUP BY ALL",
}
