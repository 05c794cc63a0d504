"""Terms that a language's texts mayn't use, and letters outside its script, by a table of rules.

The rules of a language become one automaton (Aho and Corasick 1975), with which a text is read once, however many rules
there are. Rules are few against the texts: they are sent to all tasks behind a check of their number.
"""

from __future__ import annotations

import functools
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotary.functions.lang import SCRIPTS, TERM_RULES

#: Rules that are sent to the tasks at most: some 50 MB of automaton.
MOST_RULES = 200_000
#: Kinds of rules: a term as a word or words of its own, or anywhere.
WORD, PART = "word", "part"


@functools.lru_cache(16)
def automaton(rules: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Of (term, kind): a term that is there as both kinds counts as a part."""
    out = ahocorasick.Automaton()
    kinds: dict[str, str] = {}
    for term, kind in rules:
        kinds[term] = PART if PART in (kind, kinds.get(term)) else kind
    for term, kind in kinds.items():
        out.add_word(term, (term, kind))
    if len(out):
        out.make_automaton()
    return out


def _letter(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def found_terms(text: str, rules: tuple[tuple[str, str], ...]) -> dict[str, tuple[int, int]]:
    """{term: (times, first place)} of lower-cased, composed text; places that overlap count each. A word's neighbours are
    neither letters, marks, digits nor underscores."""
    found: dict[str, tuple[int, int]] = {}
    if not rules:
        return found
    for end, (term, kind) in automaton(rules).iter(text):
        at = end - len(term) + 1
        if kind == WORD and ((at and _letter(text[at - 1])) or (end + 1 < len(text) and _letter(text[end + 1]))):
            continue
        n, first = found.get(term, (0, at))
        found[term] = (n + 1, first)
    return found


def rules_of(spark, languages: dict[str, dict] = TERM_RULES) -> DataFrame:
    """rules(lang, term, kind, instead) of the language packs: forbidden words and old forms anywhere, and forms to avoid with those to use."""
    rows = [(lang, t, PART, None) for lang, r in languages.items() for t in (*r["forbidden"], *r["old"])] + [(lang, t, PART, use) for lang, r in languages.items() for t, use in r["avoid"].items()]
    return spark.createDataFrame(rows, "lang string, term string, kind string, instead string")


def term_findings(texts: DataFrame, keys: list[str], lang: str, text: str, rules: DataFrame) -> DataFrame:
    """(keys, term, instead, n, first): P19. The terms of a text's language's rules (lang, term, kind, instead) that stand in it, how often, and the
    place of the first, from 0. Texts and terms are compared in lower case and composed (NFC); a rule of a null language holds for all.
    Null texts and texts of languages without rules have none; rules that repeat count once."""
    listed = rules.where("term is not null and term <> ''").select("lang", F.lower("term").alias("term"), "kind", "instead").distinct().limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    composed = functools.partial(unicodedata.normalize, "NFC")
    every = {(composed(r["term"]), r["kind"]): r["instead"] for r in listed if r["lang"] is None}
    by = {lang: every | {(composed(r["term"]), r["kind"]): r["instead"] for r in listed if r["lang"] == lang} for lang in {r["lang"] for r in listed}}
    known = {lang: (tuple(sorted(r)), {term: use for (term, _), use in sorted(r.items(), key=repr)}) for lang, r in by.items()}
    shared = texts.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("instead", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType())])))
    def read(language: pa.Array, column: pa.Array) -> pa.Array:
        out = []
        for name, t in zip(language.to_pylist(), column.to_pylist(), strict=True):
            of, use = shared.value.get(name) or shared.value.get(None) or ((), {})
            hits = found_terms(composed(t), of) if t else {}
            out.append([{"term": k, "instead": use[k], "n": n, "first": at} for k, (n, at) in sorted(hits.items())])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("instead", pa.string()), ("n", pa.int64()), ("first", pa.int64())])))

    return texts.select(*keys, F.explode(read(F.col(lang), F.lower(text))).alias("h")).select(*keys, "h.term", "h.instead", "h.n", "h.first")


def letters_outside(text: Column, script: str) -> Column:
    """The number of letters that aren't of a script."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[\p{{L}}&&[^\p{{Is{script}}}]]")), F.lit(0)).cast("long")


def script_findings(texts: DataFrame, keys: list[str], lang: str, text: str, scripts: dict[str, str] = SCRIPTS) -> DataFrame:
    """(keys, outside): P19. How many letters of each text are outside its language's script; null for a language without one."""
    n = F.coalesce(*[F.when(F.col(lang) == code, letters_outside(F.col(text), script)) for code, script in scripts.items()])
    return texts.select(*keys, n.alias("outside"))
