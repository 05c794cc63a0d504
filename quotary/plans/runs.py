"""Queries of runs: sources and sinks read back, requests planned by a ledger, reviews in rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import assembly, audit, chunks, plugins
from quotary.plans import alignments, assembling, checks, matching, texts, wordings
from quotary.plans.sql import words
from quotary.sources import tables as S
from quotary.sources.scratch import shared_dir
from quotary.sources.tables import table

#: What a request may cost a run, the prices of a million tokens, and tokens back a row.
CAP, PRICE, OUT = 0.02, (3.0, 15.0), 100


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quotary-{name}-{uuid.uuid4().hex}"


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events appended to JSON Lines in two goes, with broken lines between, and read back by type."""
    e, at = table(spark, d, "events").select("event_id", "event_type", "value"), _place(spark, "events")
    S.append_json_lines(e.where("event_id % 2 = 0"), at)
    S.append_json_lines(e.where("event_id % 2 = 1"), at)
    e.where("event_id % 7 = 0").select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "event_type'))).write.mode("append").text(at)
    return S.json_lines(spark, at, e.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def canon_rows(spark: SparkSession, d: str) -> DataFrame:
    """S3: the passages written as groups of ten with embedded passages, a file a group, and read back flat."""
    group = F.floor(F.col("item_id") / 10).cast("int")
    verse = F.struct((F.col("item_id") % 10 + 1).cast("int").alias("id"), "text")
    g = table(spark, d, "benchmark").groupBy(group.alias("id")).agg(F.concat(F.lit("Group "), F.first(group)).alias("name"), F.lit("g").alias("transliteration"), F.array_sort(F.collect_list(verse)).alias("verses"))
    at = _place(spark, "canon")
    g.withColumn("part", F.col("id")).repartition("part").write.partitionBy("part").json(at)
    return S.nested_canon(spark, at).select("group_id", "name", "passage_id", F.md5("text").alias("digest"))


def manifest_words(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's word times written as a manifest, a block a turn, and read back by block."""
    w = X.words(F.col("text"))
    timed = F.transform(w, lambda x, i: F.array(F.to_json(F.struct(x.alias("w"))), (i / 2).cast("string"), ((i + 1) / 2).cast("string")))
    pair = F.array_join(F.transform(timed, lambda t: F.concat(F.lit("["), F.regexp_extract(t[0], r"^\{.w.:(.*)\}$", 1), F.lit(","), t[1], F.lit(","), t[2], F.lit("]"))), ",")
    block = F.concat(F.lit('{"i": '), F.col("turn").cast("string"), F.when(F.size(w) > 0, F.concat(F.lit(', "words": ['), pair, F.lit("]"))).otherwise(""), F.lit("}"))
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), ",").alias("bs"))
    at = _place(spark, "manifests")
    m.select(F.concat(F.lit('{"audio": "a'), F.col("conv_id").cast("string"), F.lit('", "blocks": ['), "bs", F.lit("]}")).alias("value")).write.text(at)
    got = S.word_manifests(spark, at, multi_line=False)
    return got.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).cast("long").alias("chars"), F.max("end").alias("longest"))


def read_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation written as a reader, a line of files of many, a block a pair of turns between lines of marks, and read
    back; the paragraphs of which over 0.45 of the characters are from a to l stand for those of the script."""
    para = F.regexp_replace(F.trim("text"), r"\n+", "\n\n")
    b = table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", para.alias("p")))), lambda x: x["p"]), "\n\n").alias("b"))
    whole = b.groupBy("conv_id").agg(F.concat(F.lit("ANNOTATED READER VIEW\n=====\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", "b"))), lambda x: x["b"]), "\n" + "─" * 24 + "\n")).alias("text"))
    at = _place(spark, "readers")
    S.append_json_lines(whole.select(F.col("conv_id").cast("string").alias("path"), "text"), at)
    got = S.reader_blocks(spark, at, script="[a-l]", share=0.45, lines=True)
    conv = F.col("path").cast("long")
    return got.select(conv.alias("conv_id"), "block", F.md5(F.concat_ws("|", "script", "other")).alias("digest"))


def planned_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the turns of conversations, after a ledger in which each third turn is done, each seventh failed and cost something."""
    c = table(spark, d, "conversations")
    state = F.when(F.col("turn") % 3 == 1, "done").when((F.col("conv_id") + F.col("turn")) % 7 == 0, "failed")
    ledger = c.select(chunks.request_hash(F.col("text"), "m").alias("hash"), state.alias("state"), F.lit(0.001).alias("cost")).where("state is not null")
    got = chunks.requests(c, ledger, "conv_id", "turn", "text", model="m", cap=CAP, price=PRICE, out=OUT, size=3)
    return got.select("conv_id", "first", "last", "n", X.half_up(F.col("worst"), 6).alias("worst"), "allowed")


def review_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The turn two on as a first correction, the one before as a second; a fifth of them of low severity."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    one = lambda fix, n: c.withColumn("fix", fix).where("fix is not null").select("conv_id", "turn", F.lit(n).alias("round"), "fix", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "low").otherwise("high").alias("severity"))
    fixes = one(F.lead("text", 2).over(w), 1).unionByName(one(F.lag("text").over(w), 2))
    return assembly.reviewed(c, fixes, "conv_id", "turn", "text")[1].select("conv_id", "turn", "round", "verdict")


def _place_of(addresses: list[str]) -> list[dict | None]:
    """A lookup without a network: places by number, none for every tenth."""
    return [None if int(a) % 10 == 0 else {"city": f"c{int(a) % 7}", "country": f"z{int(a) % 3}", "hosting": int(a) % 11 == 0} for a in addresses]


def placed_views(spark: SparkSession, d: str) -> DataFrame:
    """Events by the place that a lookup gives their user."""
    got = plugins.placed(table(spark, d, "events").select("user_id", "event_type"), "user_id", _place_of)
    return got.groupBy("city", "country", "hosting").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def _client():
    """A client that writes 3 for e, and fails on texts with more than 40 words."""

    def answer(text: str) -> tuple[str, float]:
        if len(text.split()) > 40:
            raise ValueError("too long")
        return text.replace("e", "3"), len(text) / 1000

    return answer


def answered_requests(spark: SparkSession, d: str) -> DataFrame:
    """Turns answered by a client, and what the ledger then has."""
    ledger = plugins.answered(table(spark, d, "conversations"), "text", "m", _client)
    return ledger.select("hash", "state", F.md5("answer").alias("answer"), X.half_up(F.col("cost"), 3).alias("cost"))


def kinds_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the framing of their kind, of which every third has two parts; others are read as the first kind."""
    code = lambda n: F.concat(F.lit("k"), n.cast("string"))
    kinds = table(spark, d, "nation").select(code(F.col("n_nationkey")).alias("kind"), F.col("n_name").alias("framing"), (F.col("n_nationkey") % 3 == 0).alias("two_parts"))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, code((F.col("doc_id") % 50 / 2).cast("int"))).otherwise("other").alias("kind"))
    return plugins.with_kind(docs, kinds, "kind", "k0").groupBy("framing", "two_parts").agg(F.count(F.lit(1)).alias("n"))


def _next_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")


def transcript_problems(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a transcript, the next one as a second reading."""
    return _next_turns(spark, d).select("conv_id", "turn", audit.transcript_problem(F.col("text"), F.col("nxt"), "A-Za-zà-ü").alias("problem"))


def judged_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's wording against the next turn's, in a text that has it once, or twice where the turn's number is divisible by 5."""
    text = F.concat(F.lit("Said: "), "text", F.when(F.col("turn") % 5 == 0, F.concat(F.lit(" "), "text")).otherwise(""))
    return _next_turns(spark, d).select("conv_id", "turn", audit.judged_swap(text, F.col("text"), F.col("nxt")).alias("verdict"))


def full_gate(spark: SparkSession, d: str) -> DataFrame:
    """Eight checks of the documents, each a query of its own, and the gate over what they find."""
    said = lambda df, name, level: df.select("doc_id").distinct().select("doc_id", F.lit(name).alias("check"), F.lit(level).alias("level"))
    terms = checks.term_rules(spark, d).select("doc_id", F.col("instead").isNull().alias("none")).distinct()
    terms = terms.select("doc_id", F.when(F.col("none"), "forbidden").otherwise("avoided").alias("check"), F.when(F.col("none"), "fail").otherwise("warn").alias("level"))
    found = [
        said(texts.script_fitness(spark, d).where("reason is not null"), "fitness", "warn"), said(texts.mid_sentence_share(spark, d).where("warn"), "open", "warn"), said(matching.restarts(spark, d), "said again", "fail"),
        terms, said(alignments.recited_words(spark, d).where("last - first < 11"), "part of a passage", "warn"),
        said(matching.liturgical_share(spark, d), "formula", "warn"), said(assembling.label_faults(spark, d), "label", "fail"),
    ]
    return audit.publish_gate(found)


QUERIES = {f.__name__: f for f in (transcript_problems, judged_swaps, placed_views, answered_requests, kinds_of_documents, full_gate, event_log, canon_rows, manifest_words, read_blocks, planned_requests, review_rounds)}

_P = lambda t, n: f"regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]{{{n},}}')"
_T = lambda t: f"regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


def guard_sql(rows: str, name: str) -> str:
    """CTEs that give name(conv_id, turn, text, fix, verdict): the guard on corrections of rows(conv_id, turn, text, fix)."""
    return f"""{name}_n AS (SELECT *, lag(text) OVER o AS p, lead(text) OVER o AS n FROM {rows} WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
{name}_t AS (SELECT *, {_P('text', 3)} AS a3, {_P('fix', 3)} AS r3, {_P('p', 3)} AS p3, {_P('n', 3)} AS n3, {_T('text')} AS bt, {_T('fix')} AS ft, {_T('p')} AS pt, {_T('n')} AS nt, len({words('text')}) AS la, len({words('fix')}) AS lb FROM {name}_n),
{name}_c AS (SELECT *, list_transform(list_filter(range(1, len(a3) + 1), lambda i: len(list_filter(a3[:i], lambda v: v = a3[i])) > len(list_filter(r3, lambda v: v = a3[i]))), lambda i: a3[i]) AS cut FROM {name}_t),
{name} AS (SELECT conv_id, turn, text, fix, CASE WHEN fix IS NULL THEN 'none'
  WHEN (lb < 0.5::DOUBLE * la AND NOT (len(r3) > 0 AND len(cut) >= 5 AND (p IS NOT NULL AND len(list_filter(cut, lambda w: list_contains(p3, w))) >= 0.8::DOUBLE * len(cut) OR n IS NOT NULL AND len(list_filter(cut, lambda w: list_contains(n3, w))) >= 0.8::DOUBLE * len(cut)))) OR lb > 1.8::DOUBLE * la THEN 'length'
  WHEN len(list_filter(range(2, 9), lambda k: len(ft) >= k AND (len(pt) >= k AND pt[len(pt) - k + 1:] = ft[:k] AND bt[:k] <> ft[:k] OR len(nt) >= k AND nt[:k] = ft[len(ft) - k + 1:] AND bt[greatest(len(bt) - k + 1, 1):] <> ft[len(ft) - k + 1:]))) > 0 THEN 'neighbour' ELSE 'applied' END AS verdict FROM {name}_c)"""


SQL = {
    "event_log": "SELECT event_type, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY event_type",
    "canon_rows": "SELECT (item_id // 10)::INTEGER AS group_id, 'Group ' || (item_id // 10) AS name, (item_id % 10 + 1)::INTEGER AS passage_id, md5(text) AS digest FROM benchmark",
    "manifest_words": f"WITH w AS (SELECT conv_id, turn, {words('text')} AS w FROM conversations) SELECT turn AS block, sum(len(w))::BIGINT AS n, sum(length(array_to_string(w, '')))::BIGINT AS chars, max(len(w)) / 2.0::DOUBLE AS longest FROM w WHERE len(w) > 0 GROUP BY turn",
    "read_blocks": r"""WITH p AS (SELECT conv_id, turn // 2 AS pair, turn, unnest(list_filter(string_split_regex(trim(text), '\n+'), lambda x: true)) AS p, unnest(range(1, len(string_split_regex(trim(text), '\n+')) + 1)) AS i FROM conversations),
q AS (SELECT conv_id, pair, turn, i, trim(p, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS p FROM p), s AS (SELECT *, length(regexp_replace(p, '[^a-l]', '', 'g')) > 0.45::DOUBLE * length(regexp_replace(p, '\s', '', 'g')) AS of FROM q WHERE p <> ''),
b AS (SELECT conv_id, pair, string_agg(p, ' ' ORDER BY turn, i) FILTER (WHERE of) AS script, string_agg(p, chr(10) || chr(10) ORDER BY turn, i) FILTER (WHERE NOT of) AS other FROM s GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pair) - 1 AS block, md5(script || '|' || other) AS digest FROM b WHERE script <> '' AND other <> ''""",
    "planned_requests": f"""WITH h AS (SELECT *, sha1('m' || chr(10) || text) AS h, CASE WHEN turn % 3 = 1 THEN 'done' WHEN (conv_id + turn) % 7 = 0 THEN 'failed' END AS state FROM conversations),
l AS (SELECT h, bool_or(state = 'done') AS done, bool_or(state = 'failed') AS failed, count(*) * 0.001::DOUBLE AS cost FROM h WHERE state IS NOT NULL GROUP BY h),
t AS (SELECT h.*, coalesce(done, false) AS done, coalesce(failed, false) AS alone, cost FROM h LEFT JOIN l USING (h)), s AS (SELECT conv_id, coalesce(sum(cost), 0) AS spent FROM (SELECT DISTINCT conv_id, h, cost FROM t) GROUP BY conv_id),
i AS (SELECT *, CASE WHEN alone THEN turn ELSE turn - row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn) END AS isle FROM t WHERE NOT done), b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, alone, isle ORDER BY turn) - 1) // 3 AS b FROM i),
r AS (SELECT conv_id, alone, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n, (sum(length(text)) * {PRICE[0]}::DOUBLE + count(*) * {OUT} * {PRICE[1]}::DOUBLE) / 1e6::DOUBLE AS worst FROM b GROUP BY conv_id, alone, isle, b)
SELECT conv_id, first, last, n, floor(worst * 1000000 + 0.5) / 1000000 AS worst, spent + sum(worst) OVER (PARTITION BY conv_id ORDER BY first, alone ROWS UNBOUNDED PRECEDING) <= {CAP}::DOUBLE AS allowed FROM r JOIN s USING (conv_id)""",
    "review_rounds": f"""WITH c AS (SELECT conv_id, turn, text, lead(text, 2) OVER o AS fix, lag(text) OVER o AS fix2, (conv_id + turn) % 5 = 0 AS low FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
{guard_sql('c', 'g')}, v AS (SELECT g.conv_id, g.turn, g.text, g.fix, CASE WHEN low THEN 'low' WHEN trim(g.fix) = '' THEN 'none' WHEN g.fix = g.text THEN 'same' ELSE verdict END AS verdict, fix2, low FROM g JOIN c USING (conv_id, turn)),
c2 AS (SELECT conv_id, turn, CASE WHEN fix IS NOT NULL AND verdict = 'applied' THEN fix ELSE text END AS text, CASE WHEN fix IS NOT NULL AND verdict = 'applied' THEN fix2 END AS fix, low FROM v),
{guard_sql('c2', 'k')}, x AS (SELECT k.conv_id, k.turn, CASE WHEN low THEN 'low' WHEN trim(k.fix) = '' THEN 'none' WHEN k.fix = k.text THEN 'same' ELSE verdict END AS verdict FROM k JOIN c2 USING (conv_id, turn) WHERE k.fix IS NOT NULL)
SELECT conv_id, turn, 1 AS round, verdict FROM v WHERE fix IS NOT NULL UNION ALL SELECT conv_id, turn, 2, verdict FROM x""",
}
SQL["placed_views"] = "SELECT CASE WHEN user_id % 10 > 0 THEN 'c' || user_id % 7 END AS city, CASE WHEN user_id % 10 > 0 THEN 'z' || user_id % 3 END AS country, CASE WHEN user_id % 10 > 0 THEN user_id % 11 = 0 END AS hosting, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY ALL"
SQL["answered_requests"] = f"SELECT sha1('m' || chr(10) || text) AS hash, CASE WHEN n > 40 THEN 'failed' ELSE 'done' END AS state, CASE WHEN n <= 40 THEN md5(replace(text, 'e', '3')) END AS answer, CASE WHEN n > 40 THEN 0 ELSE floor(length(text) / 1000.0::DOUBLE * 1000 + 0.5) / 1000 END::DOUBLE AS cost FROM (SELECT DISTINCT text, len({words('text')}) AS n FROM conversations)"
SQL["kinds_of_documents"] = "SELECT n_name AS framing, n_nationkey % 3 = 0 AS two_parts, count(*)::BIGINT AS n FROM documents JOIN nation ON n_nationkey = CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 // 2 ELSE 0 END GROUP BY ALL"
SQL["transcript_problems"] = f"""WITH c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), s AS (SELECT conv_id, turn, length(regexp_replace(text, '[^A-Za-zà-ü]', '', 'g'))::DOUBLE / greatest(1, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS own, len({words('text')}) AS n, len({words('nxt')}) AS m FROM c WHERE nxt IS NOT NULL)
SELECT conv_id, turn, CASE WHEN own < 0.95::DOUBLE THEN floor(own * 100 + 0.5)::BIGINT || '% of its letters' WHEN m > 0 AND n < 0.8::DOUBLE * m THEN n || ' words against ' || m END AS problem FROM s"""
SQL["judged_swaps"] = f"""WITH c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), w AS (SELECT *, len({words('text')}) AS a, len({words('nxt')}) AS b FROM c WHERE nxt IS NOT NULL)
SELECT conv_id, turn, CASE WHEN turn % 5 = 0 OR len(string_split('Said: ' || text, text)) <> 2 THEN 'not once' WHEN text = nxt THEN 'same' WHEN b < 0.5::DOUBLE * a OR b > 1.8::DOUBLE * a THEN 'length' WHEN dropped > 0 THEN 'drops' WHEN persons > 0 THEN 'person' WHEN added > 0 THEN 'adds' ELSE 'ok' END AS verdict FROM w JOIN ({wordings.SQL["person_shifts"]}) USING (conv_id, turn)"""
_CHECKS = [
    (texts.SQL["script_fitness"], "reason IS NOT NULL", "fitness", "warn"), (texts.SQL["mid_sentence_share"], "warn", "open", "warn"), (matching.SQL["restarts"], "true", "said again", "fail"), (checks.SQL["term_rules"], "instead IS NULL", "forbidden", "fail"),
    (checks.SQL["term_rules"], "instead IS NOT NULL", "avoided", "warn"), (alignments.SQL["recited_words"], "last - first < 11", "part", "warn"), (matching.SQL["liturgical_share"], "true", "formula", "warn"), (assembling.SQL["label_faults"], "true", "label", "fail"),
]
SQL["full_gate"] = "SELECT doc_id, count(*) FILTER (WHERE level = 'fail')::BIGINT AS fails, count(*) FILTER (WHERE level = 'warn')::BIGINT AS warnings, count(*) FILTER (WHERE level = 'fail') = 0 AS passed FROM (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{name}' AS name, '{level}' AS level FROM ({sql}) WHERE {where}" for sql, where, name, level in _CHECKS) + ") GROUP BY doc_id"
SQL["guarded_reviews"] = f"WITH c AS (SELECT conv_id, turn, text, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS fix FROM conversations), {guard_sql('c', 'g')} SELECT conv_id, turn, verdict FROM g"
