"""Narrators: who a page's line names, where names stand on a chain, and which name is shown.

What a line says is told by a table of rules, read in order; the first that fits gives the names. Places on a chain come from a join
of its words with names by their sound. The shown name is the best of the candidates by a table of reasons.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.functions.names import CHAIN_END, name_keys, name_sounds, plain_name, script_sound
from quotary.functions.text import edges, words


@dataclass(frozen=True)
class Rule:
    """A line of the table. `reads` names the text that `pattern` is looked for in: the line without its framing, the text that follows
    it, or both up to the one that all chains end with. Names are a group's number, 0 for the line's own name, or a text
    with {}; with `last` the last match counts, and its name is taken as it stands. `needs` is a pattern that the line must hold, `not_name` one that the companion mayn't."""

    reads: str
    pattern: str
    narrator: int | str
    companion: int | str | None
    successor: bool = True
    needs: str = ""
    not_name: str = ""
    last: bool = False


#: What a line begins with, what ends a name, how chains name the one at their end, who isn't a narrator, and the rules in their order.
FRAMING = [r"(?i)^it (?:is|was|has been) narr?att?ed(?: on the authority of| from)?(?: that)?\s*", r"(?i)^(?:it was )?narr?att?ed\s*", r"(?i)^on the authority of\s*"]
REPORTS = r"(?i)\s+(?:who|reported|narrated|said|says|relates|relating|that|as saying)\b|\s*[:(]"
ENDS = r"(?i)\b(?:the )?(?:messenger of allah|prophet|apostle of allah)\b"
HIMSELF = r"(?i)messenger|prophet|apostle|allah\b"
RULES = [
    Rule("chain", r"(?i)\b(?:on (?:the )?authority of|from) ([^,;:]+?)(?=,|;|:| he said\b| who\b| that\b|$)", 0, 1, needs=r"(?i) narrated to us\b", not_name=r"(?i)\bhis (?:father|grandfather)\b", last=True),
    Rule("line", r"(?i)^(.+?) (?:narrated|reported) from his father,? (?:from|on the authority of) his grandfather", "{} from his father, from his grandfather", None),
    Rule("line", r"(?i)^\S+ (?:bin|ibn|b\.) (.+?) (?:narrated|reported) from his father", 1, 1, successor=False),
    Rule("line", r"(?i)^(.+?) (?:narrated|reported) (?:from|on the authority of) (?!his )(.+?)(?: that\b| who\b| saying\b|:|,)", 1, 2),
    Rule("text", r"(?i)^(?:that )?(?:he |she )?(?:I )?heard (.+?) (?:saying|say|said|narrate|narrating|reporting)\b", 0, 1, not_name=HIMSELF),
    Rule("text", r"(?i)^the companions of the prophet\b[^.]{0,12} (?:told|informed|narrated to) us", 0, "Companions of the Prophet ﷺ"),
    Rule("text", r"(?i)^(?:i|we) (?:asked|said to) (.+?)(?:,| \(| about\b| what\b| how\b| whether\b| to\b|\.|:)", 0, 1, not_name=HIMSELF),
    Rule("text", r"(?i)^(?:we|i) (?:were|was) (?:sitting )?with (.+?)(?: while| when| in| at|,|\.| and)", 0, 1, not_name=HIMSELF),
]
NO_NAME = "cast(null as string)"


def _name(text: Column) -> Column:
    """A name up to what it reports, without the marks around it; null if nothing is left."""
    bare = F.regexp_replace(F.get(F.split(F.regexp_replace(text, r"^[\s\"'“‘]+", ""), edges(REPORTS), 2), F.lit(0)), r"[\s,:]+$", "")
    return F.when(F.trim(bare) != "", F.trim(bare))


def read_line(line: Column, lead: Column, rules: list[Rule] = RULES) -> Column:
    """F16: struct<narrator, companion, successor> of a page's line and the beginning of the text after it, by the first rule that
    fits; by none the line's own name is both. An empty line names no one."""
    line = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), FRAMING, line)
    after = F.regexp_replace(F.coalesce(lead, F.lit("")), "<[^>]+>", "")
    texts = {"line": bare, "text": F.regexp_replace(after, r"^[\s\"'“‘]+", ""), "chain": F.get(F.split(F.concat_ws(" ", bare, after), edges(ENDS), 2), F.lit(0))}
    own = _name(F.regexp_replace(bare, r"^[\"“]", ""))
    struct = lambda n, c, s: F.struct(n.alias("narrator"), c.alias("companion"), F.lit(s).alias("successor"))

    def told(rule: Rule) -> Column:
        text, pattern = texts[rule.reads], edges(rule.pattern)
        found = lambda i: F.element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), -1) if rule.last else F.regexp_extract(text, pattern, i)

        def name(of: int | str | None) -> Column:
            if of is None:
                return F.expr(NO_NAME)
            if of == 0:
                return own
            if isinstance(of, int):
                return F.regexp_replace(F.trim(found(of)), r"^Ab[īi](?=\s)", "Abu") if rule.last else _name(found(of))
            return F.concat(F.lit(of.split("{}")[0]), _name(found(1)), F.lit(of.split("{}")[1])) if "{}" in of else F.lit(of)

        fits = text.rlike(pattern)
        if rule.needs:
            fits = fits & bare.rlike(edges(rule.needs))
        if rule.not_name:
            fits = fits & ~found(rule.companion).rlike(edges(rule.not_name))
        return F.when(fits, struct(name(rule.narrator), name(rule.companion), rule.successor))

    nobody = F.when(bare == "", struct(F.expr(NO_NAME), F.expr(NO_NAME), False))
    return F.coalesce(nobody, *map(told, rules), struct(own, own, False))


def chain_places(chains: DataFrame, names: DataFrame, keys: list[str], chain: str, label: str, name: str, *, sound: Callable[[Column], Column] = script_sound, end: str | None = CHAIN_END) -> DataFrame:
    """(keys, label, place): J28. The last place, from 0, at which each of `names`(keys, label, name) stands on its chain, with an
    article before it or not; names that don't stand on it have no row. Of a chain, words of the script's key in one text, the part before the word that
    ends it counts, and without such a word none; with `end` null all. Words and names meet by their sounds."""
    said = chains.select(*keys, F.explode(F.array(words(F.col(chain)))).alias("_w"))
    if end:
        stop = F.array_position(F.transform("_w", lambda w: w.rlike(end)), True)
        said = said.select(*keys, F.slice("_w", F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")).alias("_w"))
    said = said.select(*keys, F.posexplode("_w").alias("_at", "_x")).select(*keys, "_at", sound(F.col("_x")).alias("_s")).where("_s is not null")
    asked = names.select(*keys, label, F.explode(name_sounds(F.col(name))).alias("_n")).select(*keys, label, F.explode(F.array(F.col("_n"), F.concat(F.lit("l"), F.col("_n")))).alias("_s")).distinct()
    return said.join(asked, [*keys, "_s"]).groupBy(*keys, label).agg(F.max("_at").cast("long").alias("place"))


#: Reasons for showing a name, the best first, each with whose name it is.
REASONS = [("fuller", "claimed"), ("nearer", "claimed"), ("own", "narrator"), ("confirmed", "claimed"), ("companion", "companion"), ("line", "narrator")]


def shown_narrators(cards: DataFrame, key: str, page: str = "page", claimed: str = "claimed", chain: str = "chain") -> DataFrame:
    """(key, shown, reason): F17. Of a page's names and a claimed one the name that is shown, by the first of REASONS that holds; no
    name without one on the page.

    `fuller`: the claimed name is the page's with a first name before it. `nearer`: it stands on the chain, further on than every
    other name of the page, all of which stand there and none of which is like it. `own`: the page's narrator heard it themself.
    `confirmed`: the claimed name is the companion's or, where none is named, the narrator's. Keys name cards."""
    own, other = F.col(page)["narrator"], F.when(F.col(page)["successor"], F.col(page)["companion"])
    named = cards.where(own.isNotNull())
    people = F.explode(F.array(*[F.struct(F.lit(who).alias("who"), n.alias("name")) for who, n in (("claimed", F.col(claimed)), ("narrator", own), ("other", other))]))
    asked = named.select(key, people.alias("p")).select(key, "p.who", "p.name").where("name is not null")
    place = chain_places(named, asked, [key], chain, "who", "name").groupBy(key).pivot("who", ["claimed", "narrator", "other"]).agg(F.first("place"))
    near = named.join(place.select(key, *[F.col(w).alias(f"_{w}") for w in ("claimed", "narrator", "other")]), key, "left")
    said = F.col(claimed)
    alike = lambda x: F.coalesce(F.arrays_overlap(name_keys(said), name_keys(x)), F.lit(False))
    passed = lambda x, at: F.coalesce((F.col("_claimed") > at) & ~alike(x), F.lit(False))
    holds = {
        "fuller": F.coalesce(plain_name(said).endswith(F.concat(F.lit(" ibn "), plain_name(own))), F.lit(False)),
        "nearer": passed(own, F.col("_narrator")) & (other.isNull() | passed(other, F.col("_other"))),
        "own": ~F.col(page)["successor"],
        "confirmed": F.when(F.col(page)["companion"].isNull(), alike(own)).otherwise(alike(F.col(page)["companion"])) & said.isNotNull(),
        "companion": F.col(page)["companion"].isNotNull(),
        "line": F.lit(True),
    }
    name = {"claimed": said, "narrator": own, "companion": F.col(page)["companion"]}
    ranked = F.coalesce(*[F.when(holds[why], F.struct(name[whose].alias("shown"), F.lit(why).alias("reason"))) for why, whose in REASONS])
    told = near.select(key, ranked.alias("_r")).select(key, "_r.shown", "_r.reason")
    return told.unionByName(cards.where(own.isNull()).select(key, F.expr(NO_NAME).alias("shown"), F.lit("no name").alias("reason")))
