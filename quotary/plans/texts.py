"""Queries of the text functions, filters and audits over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.functions.lang import LATIN
from quotary.operators import audit as U
from quotary.operators import chunks, grams
from quotary.plans.sql import REPEATS, WS, key, keyed, words
from quotary.sources.tables import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words and lines of each document."""
    return docs(spark, d).select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """word keys by frequency."""
    return grams.tokens(docs(spark, d), "doc_id", "text").where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def script_fitness(spark: SparkSession, d: str) -> DataFrame:
    """Letters of the basic Latin script by language, and the reason to refuse a document."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    basic = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    share = F.when(letters > 0, F.floor(basic / letters * 10000 + 0.5) / 10000).otherwise(F.lit(0.0))
    return docs(spark, d).select("doc_id", "lang", share.alias("share"), F.when(share < 0.95, F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("% of its letters"))).alias("reason"))


def dominant_script(spark: SparkSession, d: str) -> DataFrame:
    """Lines with over 40 % of non-blank characters in upper case."""
    line = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    full = F.length(F.regexp_replace("t", WS, ""))
    return line.where((full > 0) & (F.length(F.regexp_replace("t", "[^A-Z]", "")) > 0.4 * full)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def stripped_markup(spark: SparkSession, d: str) -> DataFrame:
    """Documents without markup, by their digest and length."""
    t = X.strip_markup(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def forbidden_terms(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a term of the list, by document and term."""
    line = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    terms = F.filter(F.array(*map(F.lit, TERMS)), lambda x: F.contains(F.lower("t"), x))
    return line.select("doc_id", F.col("line").cast("long").alias("line"), F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


#: What the query looks for.
TERMS = ("license", "rights reserved", "password", "token", "http")


def sentence_positions(spark: SparkSession, d: str) -> DataFrame:
    """documents' sentences: number, longest, and whether the pieces rebuild the text."""
    s = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


def line_end_positions(spark: SparkSession, d: str) -> DataFrame:
    """word positions of line ends."""
    return docs(spark, d).select("doc_id", F.array_join(F.transform(X.line_ends(F.col("text")), lambda x: x.cast("string")), ",").alias("ends"))


def skeletons(spark: SparkSession, d: str) -> DataFrame:
    """words of all documents by consonant skeleton; how many distinct words share each."""
    w = grams.tokens(docs(spark, d), "doc_id", "text").select("word").where("length(word) > 3").distinct()
    return w.select(F.regexp_replace("word", "[aeiouà-ÿ]", "").alias("skeleton")).groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def near_words(spark: SparkSession, d: str) -> DataFrame:
    """words of the canon one edit apart. Such words, or they with one letter left out, are equal: an equi-join."""
    w = grams.tokens(table(spark, d, "benchmark"), "item_id", "text").select("word").where("word <> ''").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.left("word", i - 1), F.substring("word", i + 1, F.length("word"))))
    k = w.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), cut))).alias("k"))
    o = k.withColumnRenamed("word", "other")
    return k.join(o, "k").where(F.col("word") < F.col("other")).select("word", "other").distinct().where(X.near(F.col("word"), F.col("other"), 1) == 1)


def text_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """digests of cleaned texts."""
    t = F.col("text")
    subs = X.substitute(t, [("the", "T"), ("thereof", "TO"), ("and", "&")])
    return docs(spark, d).select("doc_id", F.md5(X.card_text(t)).alias("card"), F.md5(X.without_brackets(t)).alias("bare"), F.md5(subs).alias("subs"), X.count_of(t, F.lit("the ")).alias("n_the"))


def ordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """the share of word pairs that a turn has in common with the next."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("n", nxt).where("n is not null")
    return c.select("conv_id", "turn", X.half_up(X.pair_share(X.words(F.lower("text")), X.words(F.lower("n"))), 4).alias("share"))


def turn_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of neighbouring turns."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("n", nxt).where("n is not null")
    return c.select("conv_id", "turn", X.half_up(X.jaccard(X.words(F.lower("text")), X.words(F.lower("n"))), 4).alias("jaccard"))


def run_positions(spark: SparkSession, d: str) -> DataFrame:
    """where the last three words of a turn stand in it first."""
    w = X.words(F.col("text"))
    last = F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
    return table(spark, d, "conversations").select("conv_id", "turn", X.run_index(w, last).alias("at"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """title, links and text length of stored pages."""
    title = X.decode_entities(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.size(links).cast("long").alias("links"), F.get(links, F.lit(0)).alias("first_link"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    """pages without tags, by digest."""
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


def lost_words(spark: SparkSession, d: str) -> DataFrame:
    """Words lost and doubled between a document and its lines without the first."""
    shown = docs(spark, d).select("doc_id", F.array_join(F.slice(F.split("text", "\n"), F.lit(2), F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(1))), "\n").alias("text"))
    return U.word_coverage(docs(spark, d), shown, "doc_id", "text")


def pairing_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Words of a turn against the next."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("n", nxt).where("n is not null")
    return U.pairing_outliers(c, "conv_id", "turn", F.size(X.words(F.col("text"))), F.size(X.words(F.col("n"))))


def missing_turns(spark: SparkSession, d: str) -> DataFrame:
    """Numbers missing among turns of users."""
    return U.missing_numbers(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn")


def multiset_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of even and of odd documents, as multisets, by how many are on one side."""
    t = lambda k: grams.tokens(docs(spark, d).where(F.col("doc_id") % 2 == k), "doc_id", "text").select("word")
    return U.multiset_diff(t(0), t(1)).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"))


def swap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A turn's wording against the one two turns on."""
    nxt = F.lead("text", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("n", nxt).where("n is not null")
    return c.select("conv_id", "turn", U.swap_verdict(F.col("text"), F.col("n")).alias("verdict"))


def swapped_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document replaced by its lower-case form where it stands exactly once."""
    first = F.element_at(F.split("text", "\n"), 1)
    return docs(spark, d).where(F.length(first) > 0).select("doc_id", F.md5(U.quote_swap(F.col("text"), first, F.lower(first))).alias("digest"), (X.count_of(F.col("text"), first) == 1).alias("once"))


def missing_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of a turn that the next one lacks, one edit forgiven."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, d, "conversations").withColumn("n", nxt).where("n is not null")
    return c.select("conv_id", "turn", F.size(U.words_missing(F.col("text"), F.col("n"))).cast("long").alias("n"))


def mid_sentence_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of lines that don't end a sentence."""
    line = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return line.groupBy("doc_id").agg(F.round(F.avg((~F.col("t").rlike(r"[.!?]\s*$")).cast("double")), 6).alias("open"), (F.avg((~F.col("t").rlike(r"[.!?]\s*$")).cast("double")) > 0.25).alias("warn"))


def context_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two turns before and two after, by their lengths."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = F.collect_list(F.length("text")).over(w.rowsBetween(-2, 2))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(around, lambda x: x.cast("string")), ",").alias("around"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 30 words."""
    return chunks.fixed_chunks(docs(spark, d), "doc_id", "text")


def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    """Chunks at sentence and line ends."""
    return chunks.chunk_prose(docs(spark, d), "doc_id", "text")


def request_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns in batches of at most 3 that follow each other, system turns left out."""
    return chunks.batches(table(spark, d, "conversations").where("role <> 'system'"), ["conv_id"], "turn", 3)


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """conversations' turns cut in two at their middle word and numbered anew."""
    w = X.words(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("h"), half.alias("n")), F.struct(F.lit(1).alias("h"), (F.size(w) - half).alias("n")))
    r = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.filter(parts, lambda x: x["n"] > 0)).alias("p"))
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p.h")) - 1
    return r.select("conv_id", "turn", i.cast("long").alias("idx"), F.col("p.n").cast("long").alias("n_words"))


def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fixed chunks of a document and of it without its last line: rows that differ."""
    cut = docs(spark, d).select("doc_id", F.array_join(F.slice(F.split("text", "\n"), F.lit(1), F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(1))), "\n").alias("text"))
    a, b = chunks.fixed_chunks(docs(spark, d), "doc_id", "text"), chunks.fixed_chunks(cut, "doc_id", "text").withColumnRenamed("c_end", "new_end").drop("c_start")
    return a.join(b, ["doc_id", "chunk_idx"], "full_outer").where(~F.col("c_end").eqNullSafe(F.col("new_end"))).select("doc_id", "chunk_idx", "c_end", "new_end")


def gate(spark: SparkSession, d: str) -> DataFrame:
    """Checks of documents as plug-ins, and the gate over all of them."""
    fit = script_fitness(spark, d).where("reason is not null").select("doc_id", F.lit("fitness").alias("check"), F.lit("warn").alias("level"))
    open_ = mid_sentence_share(spark, d).where("warn").select("doc_id", F.lit("open").alias("check"), F.lit("warn").alias("level"))
    again = chunks.find_repeats(docs(spark, d), "doc_id", "text", formula=LATIN.formula).select("doc_id").distinct().select("doc_id", F.lit("repeat").alias("check"), F.lit("fail").alias("level"))
    return U.publish_gate([fit, open_, again])


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, word_frequencies, script_fitness, dominant_script, stripped_markup, forbidden_terms, sentence_positions, line_end_positions, skeletons, near_words, text_cleaning, ordered_pairs, turn_jaccard, run_positions, page_fields,
        page_text, lost_words, pairing_outliers, missing_turns, multiset_words, swap_verdicts, swapped_texts, missing_words, mid_sentence_share, context_rows, fixed_chunks, chunk_prose, request_batches, split_rows, version_changes, gate,
    )
}

_LINES = "l AS (SELECT doc_id, (i - 1)::BIGINT AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_NEXT = "c AS (SELECT * FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL)"
_LOW = lambda t: f"list_distinct({words(f'lower({t})')})"
_CHUNKS = lambda name, text: f"{name}_n AS (SELECT doc_id, len({words(text)})::BIGINT AS n FROM documents), {name} AS (SELECT doc_id, i AS chunk_idx, i * 30 AS c_start, least((i + 1) * 30, n) AS c_end FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 30.0) AS BIGINT))) AS i FROM {name}_n))"
_PAIRS = lambda t: f"list_distinct(list_transform(range(1, greatest(len({words(f'lower({t})')}), 1)), lambda i: array_to_string(({words(f'lower({t})')})[i:i + 1], ' ')))"
_SHARE = "s AS (SELECT doc_id, lang, CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 THEN floor(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) * 10000 + 0.5) / 10000 ELSE 0.0 END AS share FROM documents)"
_OPEN = f"{_LINES}, op AS (SELECT doc_id, avg((NOT regexp_matches(t, '[.!?]\\s*$'))::INT::DOUBLE) AS o FROM l GROUP BY doc_id)"
_REP = f"""{REPEATS}, rr AS (SELECT DISTINCT doc_id FROM good)"""
#: DuckDB's edit distance counts bytes: letters with accents are written as one byte each.
_ACCENTS, _BYTES = "".join(chr(c) for c in range(0xE0, 0x100)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*"
SQL = {
    "word_counts": f"SELECT doc_id, len({words('text')})::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents",
    "word_frequencies": f"SELECT word, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest({keyed('text')}) AS word FROM documents) WHERE word <> '' GROUP BY word",
    "script_fitness": f"WITH {_SHARE} SELECT *, CASE WHEN share < 0.95 THEN floor(share * 100 + 0.5)::BIGINT || '% of its letters' END AS reason FROM s",
    "dominant_script": f"WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS lines FROM l WHERE length(regexp_replace(t, '{WS}', '', 'g')) > 0 AND length(regexp_replace(t, '[^A-Z]', '', 'g')) > 0.4 * length(regexp_replace(t, '{WS}', '', 'g')) GROUP BY doc_id",
    "stripped_markup": f"""WITH t AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '[﴾﴿{{}}]', '', 'g'), chr(10)), lambda x: array_to_string(list_filter(string_split_regex(x, '{WS}'), lambda w: w <> '' AND NOT regexp_matches(w, '^[*۞]+$')), ' ')), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM t""",
    "forbidden_terms": f"WITH {_LINES}, k AS (SELECT unnest({list(TERMS)}) AS term) SELECT doc_id, term, count(*)::BIGINT AS n, min(line) AS first_line FROM l JOIN k ON contains(lower(t), term) GROUP BY ALL",
    "sentence_positions": r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '([^.!?]+[.!?]*\s*|[.!?]+\s*)', 0) AS p FROM documents), x AS (SELECT doc_id, CASE WHEN array_to_string(p, '') = text THEN p ELSE [text] END AS p FROM s)
SELECT doc_id, len(p)::BIGINT AS n, list_max(list_transform(p, lambda y: length(y)))::BIGINT AS longest FROM x""",
    "line_end_positions": f"""WITH {_LINES}, n AS (SELECT doc_id, line, sum(len({words('t')})) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS e, max(line) OVER (PARTITION BY doc_id) AS m FROM l)
SELECT doc_id, coalesce(string_agg(e, ',' ORDER BY line) FILTER (WHERE line < m), '') AS ends FROM n GROUP BY doc_id""",
    "skeletons": f"WITH w AS (SELECT DISTINCT unnest({keyed('text')}) AS w FROM documents) SELECT regexp_replace(w, '[aeiouà-ÿ]', '', 'g') AS skeleton, count(*)::BIGINT AS n FROM w WHERE length(w) > 3 GROUP BY 1 HAVING count(*) > 1",
    "near_words": f"WITH w AS (SELECT word, translate(word, '{_ACCENTS}', '{_BYTES}') AS b FROM (SELECT DISTINCT unnest({keyed('text')}) AS word FROM benchmark)) SELECT a.word, b.word AS other FROM w a JOIN w b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 1 AND a.word <> '' AND levenshtein(a.b, b.b) = 1",
    "text_cleaning": f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '^\\s*[0-9]+[.:)]\\s*', ''), '\\[[0-9]+\\]|\\*+', '', 'g'), '{WS}', ' ', 'g'))) AS card,
md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '{WS}', ' ', 'g'))) AS bare,
md5(replace(replace(replace(text, 'thereof', 'TO'), 'the', 'T'), 'and', '&')) AS subs, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS n_the FROM documents""",
    "ordered_pairs": f"WITH {_NEXT}, p AS (SELECT conv_id, turn, {_PAIRS('text')} AS a, {_PAIRS('n')} AS b, {words('lower(text)')} AS wa, {words('lower(n)')} AS wb FROM c), q AS (SELECT conv_id, turn, CASE WHEN len(wa) = 1 THEN wa ELSE a END AS a, CASE WHEN len(wb) = 1 THEN wb ELSE b END AS b FROM p) SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN floor(len(list_intersect(a, b))::DOUBLE / len(a) * 10000 + 0.5) / 10000 ELSE 0.0 END AS share FROM q",
    "turn_jaccard": f"WITH {_NEXT}, p AS (SELECT conv_id, turn, {_LOW('text')} AS a, {_LOW('n')} AS b FROM c) SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN floor(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * 10000 + 0.5) / 10000 ELSE 0.0 END AS jaccard FROM p",
    "run_positions": f"WITH w AS (SELECT conv_id, turn, {words('text')} AS w FROM conversations), p AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i:i + least(len(w), 3) - 1] = w[greatest(len(w) - 2, 1):len(w)]) AS ps FROM w) SELECT conv_id, turn, (CASE WHEN len(w) = 0 THEN -1 ELSE ps[1] - 1 END)::BIGINT AS at FROM p",
    "page_fields": """SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title,
len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::BIGINT AS links, regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS first_link FROM pages""",
    "page_text": f"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '{WS}', ' ', 'g'))) AS digest FROM pages""",
    "lost_words": f"""WITH a AS (SELECT doc_id, w, count(*) AS a FROM (SELECT doc_id, unnest({keyed('text')}) AS w FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, w, count(*) AS b FROM (SELECT doc_id, unnest({keyed("array_to_string(list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))), chr(10))")}) AS w FROM documents) GROUP BY ALL)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS lost, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS doubled FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY 1""",
    "pairing_outliers": f"""WITH {_NEXT}, r AS (SELECT conv_id, turn, len({words('text')})::DOUBLE AS a, len({words('n')})::DOUBLE AS b FROM c), q AS (SELECT *, b / a AS ratio, row_number() OVER (PARTITION BY conv_id ORDER BY b / a, turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r WHERE a > 0 AND b > 0),
m AS (SELECT *, max(CASE WHEN i = n // 2 + 1 THEN ratio END) OVER (PARTITION BY conv_id) AS m FROM q)
SELECT conv_id, turn, round(ratio, 6) AS ratio, (b > 2.2 * a * m OR b * 2.2 < a * m) AND abs(b - a * m) > 8 AS outlier FROM m""",
    "missing_turns": "WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), e AS (SELECT conv_id, unnest(range(min(turn), max(turn) + 1)) AS missing FROM u GROUP BY conv_id) SELECT e.conv_id, e.missing FROM e ANTI JOIN u ON e.conv_id = u.conv_id AND e.missing = u.turn",
    "multiset_words": f"""WITH a AS (SELECT unnest({keyed('text')}) AS word FROM documents WHERE doc_id % 2 = 0), b AS (SELECT unnest({keyed('text')}) AS word FROM documents WHERE doc_id % 2 = 1),
x AS (SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT side, count(*)::BIGINT AS n, count(DISTINCT word)::BIGINT AS words FROM x GROUP BY side""",
    "swap_verdicts": f"""WITH c AS (SELECT * FROM (SELECT *, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL), p AS (SELECT conv_id, turn, len({words('text')}) AS a, len({words('n')}) AS b, {keyed('text')} AS ka, {keyed('n')} AS kb, regexp_extract_all(text, '[0-9]+') AS da, regexp_extract_all(n, '[0-9]+') AS db FROM c)
SELECT conv_id, turn, CASE WHEN b < 0.5 * a OR b > 1.8 * a THEN 'length' WHEN list_has_any(kb, ['i', 'me', 'my', 'mine']) AND NOT list_has_any(ka, ['i', 'me', 'my', 'mine']) THEN 'person' WHEN len(list_filter(da, lambda x: NOT list_contains(db, x))) > 0 THEN 'dropped' ELSE 'ok' END AS verdict FROM p""",
    "swapped_texts": """WITH f AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS a FROM documents), o AS (SELECT *, (length(text) - length(replace(text, a, ''))) // length(a) = 1 AS once FROM f WHERE length(a) > 0)
SELECT doc_id, md5(CASE WHEN once THEN replace(text, a, lower(a)) ELSE text END) AS digest, once FROM o""",
    "missing_words": f"""WITH {_NEXT}, p AS (SELECT conv_id, turn, list_distinct(list_filter({keyed('text')}, lambda w: length(w) > 3 AND regexp_matches(w, '^[a-z0-9]+$'))) AS a, list_distinct(list_filter({keyed('n')}, lambda w: length(w) > 3 AND regexp_matches(w, '^[a-z0-9]+$'))) AS b FROM c)
SELECT conv_id, turn, len(list_filter(a, lambda w: len(list_filter(b, lambda v: levenshtein(w, v) <= 1)) = 0))::BIGINT AS n FROM p""",
    "mid_sentence_share": f"WITH {_OPEN} SELECT doc_id, round(o, 6) AS open, o > 0.25 AS warn FROM op",
    "context_rows": "SELECT conv_id, turn, array_to_string(list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS around FROM conversations",
    "fixed_chunks": f"WITH {_CHUNKS('c', 'text')} SELECT * FROM c",
    "request_batches": "WITH i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role <> 'system'), b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) - 1) // 3 AS b FROM i) SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n FROM b GROUP BY conv_id, g, b",
    "split_rows": f"""WITH w AS (SELECT conv_id, turn, len({words('text')}) AS n FROM conversations), p AS (SELECT conv_id, turn, 0 AS h, n // 2 AS n FROM w UNION ALL SELECT conv_id, turn, 1, n - n // 2 FROM w)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, h) - 1 AS idx, n::BIGINT AS n_words FROM p WHERE n > 0""",
    "version_changes": f"""WITH {_CHUNKS('a', 'text')}, {_CHUNKS('b', "array_to_string(list_slice(string_split(text, chr(10)), 1, greatest(len(string_split(text, chr(10))) - 1, 1)), chr(10))")}
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx, a.c_end, b.c_end AS new_end FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.chunk_idx = b.chunk_idx WHERE a.c_end IS DISTINCT FROM b.c_end""",
    "gate": f"""WITH RECURSIVE {_SHARE}, {_OPEN}, {_REP}, k AS (SELECT doc_id, 'warn' AS level FROM s WHERE share < 0.95 UNION ALL SELECT doc_id, 'warn' FROM op WHERE o > 0.25 UNION ALL SELECT doc_id, 'fail' FROM rr)
SELECT doc_id, count(*) FILTER (WHERE level = 'fail')::BIGINT AS fails, count(*) FILTER (WHERE level = 'warn')::BIGINT AS warnings, count(*) FILTER (WHERE level = 'fail') = 0 AS passed FROM k GROUP BY doc_id""",
}
