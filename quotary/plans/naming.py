"""Queries of names: who a line names, where names stand on a chain, what stands behind an attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import names as N
from quotary.functions import text as X
from quotary.operators import narrators as R
from quotary.plans.sql import WS, words
from quotary.sources.tables import table

#: Attributions of the tables' languages, and the reporting word behind which a text goes on where none fits.
SAID = (r"\b(?:that|que|dass)\s+", r"\b(?:and|et|y|und)\s+")
LAST = "la"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("nxt"))


def line_narrators(spark: SparkSession, d: str) -> DataFrame:
    """Lines made of the first two words of each turn, in five shapes, with the last word of the turn as the claimed name: who narrates,
    who is shown, and why."""
    w = F.filter(F.transform(X.words(F.col("text")), lambda x: F.regexp_replace(x, "[^A-Za-z]", "")), lambda x: F.length(x) > 2)
    t = _turns(spark, d).select("conv_id", "turn", w.alias("w")).where(F.size("w") > 1).withColumns({"a": F.get("w", F.lit(0)), "b": F.get("w", F.lit(1)), "claimed": F.element_at("w", -1)})
    shape = lambda *parts: F.concat(*[F.col(p) if p in "ab" else F.lit(p) for p in parts])
    line = F.element_at(F.array(shape("Narrated ", "a", ":"), shape("a", " narrated from ", "b", " that he spoke"), shape("It was narrated that ", "a", " said:"), shape("a", " bin ", "b", " narrated from his father"), F.lit("")), (F.col("turn") % 5 + 1).cast("int"))
    lead = F.when(F.col("turn") % 5 == 0, F.when(F.length("b") > 3, shape("I heard ", "b", " saying so")))
    cards = t.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")).withColumns({"page": R.read_line(line, lead), "chain": F.lit(None).cast("string")})
    return cards.join(R.shown_narrators(cards, "id"), "id").select("conv_id", "turn", F.col("page.narrator").alias("narrator"), F.col("page.companion").alias("companion"), "shown", "reason")


def chain_order(spark: SparkSession, d: str) -> DataFrame:
    """For each word of a turn's successor, as a name, the last place at which it stands, by its sound, among the turn's words."""
    t = _turns(spark, d).where("nxt is not null")
    names = t.select("conv_id", "turn", F.posexplode(X.words(F.col("nxt"))).alias("label", "name"))
    got = R.chain_places(t, names, ["conv_id", "turn"], "text", "label", "name", sound=lambda w: F.get(N.name_sounds(w), F.lit(0)), end=None)
    return got.select("conv_id", "turn", F.col("label").cast("long").alias("label"), "place")


def bodies_said(spark: SparkSession, d: str) -> DataFrame:
    """what each turn says behind its attribution."""
    low = F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")
    b = N.body(low, [X.edges(p) for p in SAID], LAST, 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(b).cast("long").alias("n"), F.md5(b).alias("digest"))


QUERIES = {f.__name__: f for f in (line_narrators, chain_order, bodies_said)}

_ONCE = lambda x: reduce(lambda t, c: f"regexp_replace({t}, '{c}{c}+', '{c}', 'g')", "bcdfghjklmnpqrstvxz", x)
_SOUND = lambda w: f"regexp_replace({_ONCE(f'regexp_replace({reduce(lambda t, p: f"replace({t}, {p[0]!r}, {p[1]!r})", N.DIGRAPHS, w)}, $$[aeiouyw]$$, $$$$, $$g$$)')}, '(.)h$', '\\1')"
_PLAIN = lambda w: f"regexp_replace(lower(regexp_replace({w}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z\\s-]', '', 'g')"
_SOUNDS = lambda w: f"list_filter(list_transform(list_filter(string_split_regex({_PLAIN(w)}, '[\\s-]+'), lambda w: w <> '' AND w NOT IN {N.NAME_STOP} AND NOT regexp_matches(w, '^ab[uio][a-z]?$')), lambda w: {_SOUND('w')}), lambda k: length(k) >= 2)"
_KEY = lambda n: f"list_distinct(list_filter(list_transform(list_filter(string_split_regex(regexp_replace(lower({n}), '[^a-z\\s-]', '', 'g'), '[\\s-]+'), lambda w: w <> '' AND w NOT IN {N.NAME_STOP}), lambda w: list_transform([translate(regexp_replace(w, '^al', ''), 'oe', 'ui')], lambda v: left(v, 1) || regexp_replace({_ONCE('regexp_replace(substr(v, 2), $$[aeiouyw]$$, $$$$, $$g$$)')}, '(.)h$', '\\1'))[1]), lambda k: length(k) >= 2))"
_BODY = lambda p: f"trim(regexp_extract(t, '(?s)^.*?{p}(.*)$', 1))"
SQL = {
    "line_narrators": f"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform({words('text')}, lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')), lambda x: length(x) > 2) AS w FROM conversations),
l AS (SELECT conv_id, turn, w[-1] AS claimed, CASE turn % 5 WHEN 0 THEN 'Narrated ' || w[1] || ':' WHEN 1 THEN w[1] || ' narrated from ' || w[2] || ' that he spoke' WHEN 2 THEN 'It was narrated that ' || w[1] || ' said:' WHEN 3 THEN w[1] || ' bin ' || w[2] || ' narrated from his father' ELSE '' END AS l,
  CASE WHEN turn % 5 = 0 AND length(w[2]) > 3 THEN 'I heard ' || w[2] || ' saying so' END AS t FROM w WHERE len(w) > 1),
b AS (SELECT *, regexp_replace(regexp_replace(l, '(?i)^it (is|was|has been) narr?att?ed( on the authority of| from)?( that)?\\s*', ''), '(?i)^(it was )?narr?att?ed\\s*', '') AS b FROM l),
p AS (SELECT *, CASE WHEN b = '' THEN NULL WHEN regexp_matches(b, '^\\S+ bin .+? narrated from his father') THEN regexp_extract(b, '^\\S+ bin (.+?) narrated from his father', 1) WHEN regexp_matches(b, '^.+? narrated from .+? that\\b') THEN regexp_extract(b, '^(.+?) narrated from', 1) ELSE trim(string_split_regex(b, '\\s+said\\b|\\s*:')[1]) END AS narrator,
  CASE WHEN b = '' THEN NULL WHEN regexp_matches(b, '^.+? narrated from his father') THEN regexp_extract(b, '^\\S+ bin (.+?) narrated', 1) WHEN regexp_matches(b, '^.+? narrated from .+? that\\b') THEN regexp_extract(b, ' narrated from (.+?) that\\b', 1) WHEN t IS NOT NULL THEN regexp_extract(t, 'heard (.+?) saying', 1) ELSE trim(string_split_regex(b, '\\s+said\\b|\\s*:')[1]) END AS companion,
  b <> '' AND (regexp_matches(b, '^.+? narrated from .+? that\\b') OR t IS NOT NULL) AS successor FROM b)
SELECT conv_id, turn, narrator, companion, CASE WHEN narrator IS NULL THEN NULL WHEN NOT successor THEN narrator WHEN list_has_any({_KEY('claimed')}, {_KEY('companion')}) THEN claimed ELSE companion END AS shown,
CASE WHEN narrator IS NULL THEN 'no name' WHEN NOT successor THEN 'own' WHEN list_has_any({_KEY('claimed')}, {_KEY('companion')}) THEN 'confirmed' ELSE 'companion' END AS reason FROM p""",
    "chain_order": f"""WITH c AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), t AS (SELECT conv_id, turn, {words('text')} AS w, {words('nxt')} AS x FROM c WHERE nxt IS NOT NULL),
a AS (SELECT conv_id, turn, i - 1 AS at, ({_SOUNDS('w[i]')})[1] AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)), b AS (SELECT conv_id, turn, i - 1 AS label, unnest({_SOUNDS('x[i]')}) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM t))
SELECT a.conv_id, a.turn, label::BIGINT AS label, max(a.at)::BIGINT AS place FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND (s = n OR s = 'l' || n) GROUP BY a.conv_id, a.turn, label""",
    "bodies_said": f"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '{WS}', ' ', 'g') AS t FROM conversations), m AS (SELECT *, length(t) - instr(reverse(t), reverse('la')) - 2 + 1 AS pos FROM t),
b AS (SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(t, '{p}') AND len({words(_BODY(p))}) >= 3 THEN {_BODY(p)}" for p in SAID)} WHEN contains(t, 'la') AND pos > length(t) * 0.4::DOUBLE THEN trim(substr(t, pos + 4)) ELSE t END AS b FROM m) SELECT conv_id, turn, length(b)::BIGINT AS n, md5(b) AS digest FROM b""",
}
