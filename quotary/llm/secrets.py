"""Secret scanning: a trigram inverted index answers Boolean queries derived from the rules; only candidates are matched.

DataFrame and SQL expressions only. The rules are few and known on the driver; their patterns are analysed there, once.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` is the part of a match that must have `least` characters; shorter matches are dropped.
    `gate`, where given, is a plainer pattern that any passing match contains: it spares texts the listing of short ones."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    gate: str = ""


#: The base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
#: Further public formats, listed after the base kinds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: A literal set larger than this is not multiplied out further.
MOST_LITERALS = 64
#: Matches whose places are added up at a time.
RUN = 256


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Boolean query of lower-case ASCII trigrams that every text with a match fulfils: an OR of ANDs.

    An empty AND among them (or an empty list) means that the pattern has no mandatory trigram. After Cox 2012, on the
    parsed pattern: consecutive literals are joined to runs, alternatives and optional parts multiply the runs.
    """
    from re import _parser as parser  # the standard library's own pattern parser

    def runs(items) -> list[tuple[tuple[str, ...], bool]]:
        """Each alternative as its literal runs; a run ends where anything but a literal stands."""
        found: list[list[str]] = [[""]]

        def then(options: list[list[str]]) -> None:
            nonlocal found
            if len(found) * len(options) > MOST_LITERALS:
                options = [["", ""]]  # an open break: nothing is demanded here
            found = [a[:-1] + [a[-1] + b[0]] + b[1:] for a, b in itertools.product(found, options)]

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                then([[chr(arg).lower()]])
            elif name == "IN" and len(arg) <= 8 and all(str(x) == "LITERAL" for x, _ in arg):
                then([[chr(c).lower()] for _, c in arg])
            elif name == "SUBPATTERN":
                then([list(x) for x in runs(arg[3])])
            elif name == "BRANCH":
                then([list(x) for branch in arg[1] for x in runs(branch)])
            elif name == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] <= 8:
                for _ in range(arg[0]):
                    then([list(x) for x in runs(arg[2])])
            elif name == "MAX_REPEAT" and (arg[0], arg[1]) == (0, 1):
                then([[""], *[list(x) for x in runs(arg[2])]])
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                inner = runs(arg[2])
                then([[*x, *x] if len(x) > 1 else [x[0], x[0]] for x in map(list, inner)])
            else:
                then([["", ""]])
        return [tuple(x) for x in found]

    every = []
    for run in runs(parser.parse(pattern)):
        grams = frozenset(part[i : i + 3] for part in run for i in range(len(part) - 2))
        every.append(frozenset(g for g in grams if g.isascii()))
    return [] if not every or any(not x for x in every) else sorted(set(every), key=sorted)


def trigram_index(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """Postings (gram, key): which rows contain each of the given lower-case trigrams. The lower-cased text is a column of its
    own, made once a row."""
    low = F.col("_low")
    docs = docs.select(F.col(key), F.lower(F.col(text)).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(key), F.explode(found).alias("gram"))


def candidates(index: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query a row's postings fulfil.

    The intersection of a clause's posting lists is taken for all rows at once: postings are gathered by row, combined
    before the shuffle, and a clause holds where all of its trigrams have come together.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    met = [F.when(reduce(lambda a, b: a | b, [F.forall(F.lit(sorted(c)), lambda g: F.array_contains("grams", g)) for c in q]), F.lit(k)) for k, q in queries.items() if q]
    return index.groupBy(key).agg(F.collect_set("gram").alias("grams")).select(key, F.array_compact(F.array(*met)).alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>>: the rule's leftmost non-overlapping matches that pass, in code points, end exclusive.

    The pieces between the matches and the matches alternate, so their lengths add up to each match's place.
    """
    if rule.gate:  # runs of one class: the longer runs alone are the same matches
        rule = Rule(rule.kind, re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern), 0, 0)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))), F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(part, F.length).alias("part"))
    spans = "array<struct<start:int,end:int>>"

    def place(s: Column, x: Column) -> Column:
        """The running end `at`, and the spans so far."""
        start, end = s["at"] + x["gap"], s["at"] + x["gap"] + x["n"]
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["found"]).alias("found"))

    def shift(s: Column, x: Column) -> Column:
        moved = F.transform(x["found"], lambda y: F.struct((y["start"] + s["at"]).alias("start"), (y["end"] + s["at"]).alias("end")))
        return F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["found"], F.array(moved)).alias("found"))

    # runs of RUN matches, then the runs: appending to one list would copy it for every match of a long text
    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(RUN))).otherwise(F.lit([]).cast("array<int>"))
    runs = F.transform(starts, lambda i: F.aggregate(F.slice(rows, i, F.lit(RUN)), F.struct(F.lit(0).alias("at"), F.lit([]).cast(spans).alias("found")), place))
    return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{spans}>").alias("found")), shift)["found"])


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `found`: array<struct<start, rank, kind, end>> of all passing matches, by start and then rule order.

    Null and empty texts have none. A rule with a trigram query is tried only on rows that fulfil it; a rule without one
    scans every row. Keys may repeat or be null: candidates of equal keys are tried on each of their rows, and matches
    decide. A column `found` of docs is replaced; other columns are kept. An empty table gives an empty result.
    """
    docs = docs.drop("found")
    none = F.lit([]).cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def found(rank: int, rule: Rule, body: Column) -> Column:
        tried = body.rlike(rule.gate) if rule.gate else F.array_contains("_kinds", rule.kind)
        spans = F.transform(spans_of(body, rule), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))
        return F.when(tried, spans).otherwise(none) if rule.gate or trigram_query(rule.pattern) else spans

    queries = [trigram_query(r.pattern) for r in rules]
    scanned = [found(i, r, F.coalesce(F.col(text), F.lit(""))) for i, r in enumerate(rules) if not queries[i]]
    # rules without a query are matched where the text is read, so the text itself needn't follow into the joins below
    rows = docs.withColumns({"_scanned": F.concat(*scanned) if scanned else none, "_text": F.xxhash64(text, F.octet_length(text))})
    grams = sorted({g for q in queries for c in q for g in c})
    if not grams:
        return rows.withColumn("found", F.array_sort("_scanned")).drop("_scanned", "_text")
    got = candidates(trigram_index(docs, key, text, grams), key, rules).select(F.col(key).alias("_key"), F.col("kinds").alias("_kinds"))
    got = materialize(got, "candidates")  # its size is known then: a small list is broadcast by Spark's own check, a large one is shuffled
    tried = docs.select(F.col(key).alias("_of"), F.coalesce(F.col(text), F.lit("")).alias("_body"), F.xxhash64(text, F.octet_length(text)).alias("_body_hash")).join(got, F.col("_of").eqNullSafe(F.col("_key")))
    verified = tried.select("_of", "_body_hash", F.concat(*[found(i, r, F.col("_body")) for i, r in enumerate(rules) if queries[i]]).alias("_verified")).where(F.size("_verified") > 0).dropDuplicates(["_of", "_body_hash"])
    joined = rows.join(verified, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_body_hash")), "left")
    return joined.withColumn("found", F.array_sort(F.concat("_scanned", F.coalesce("_verified", none)))).drop("_scanned", "_text", "_of", "_body_hash", "_verified")


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with counts and a digest of the base kinds."""
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array("found")).alias("found"))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    n = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql() -> str:
    """DuckDB SQL of op7: the places of matches from the lengths of the pieces between them, rule by rule."""

    def kind(rank: int, r: Rule) -> str:
        pat = r.pattern.replace("'", "''")
        pat = re.sub(r"\+$", f"{{{r.least},}}", pat) if r.gate else pat
        group = 0 if r.gate else r.group
        return f"""
  SELECT row_no, {rank} AS rank, '{r.kind}' AS kind, sum(gap + n) OVER o - n AS s, sum(gap + n) OVER o AS e, part FROM (
    SELECT row_no, i, len(gaps[i]) AS gap, len(ms[i]) AS n, len(parts[i]) AS part FROM (
      SELECT row_no, string_split_regex(body, '{pat}') AS gaps, regexp_extract_all(body, '{pat}') AS ms, regexp_extract_all(body, '{pat}', {group}) AS parts FROM d
    ), unnest(range(1, len(ms) + 1)) AS t(i)
  ) WINDOW o AS (PARTITION BY row_no ORDER BY i)
"""

    union = "UNION ALL".join(kind(i, r) for i, r in enumerate(RULES))
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents),
m AS ({union}),
p AS (SELECT * FROM m WHERE part >= CASE kind {least} END),
g AS (
  SELECT row_no, {counts},
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM p GROUP BY row_no
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""


OP7_SQL = _sql()
