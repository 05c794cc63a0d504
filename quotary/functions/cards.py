"""Rules on shown texts: pairs, excerpts, takes, names and numbers that a wording adds or drops, repeats of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotary.functions.text import edges, let, trim_quotes, words

#: Capitalised words that are no names; number words; words that may be dropped.
CAPITAL_STOP = (
    "the a an and but or so then he his him she her it its i we our us you your they them their o if when whoever who what which that this these those there none no not nor by in on of for to at with from as is are "
    "was were be do does did have has had say said indeed verily allah allah's messenger prophet prophets apostle lord muslims muslim islam paradise fire hell hellfire day book quran qur'an hereafter resurrection "
    "judgment judgement majestic exalted most high glorified mighty merciful gracious almighty praise peace blessings may one all every each whosoever whomever let yes nay amen companion companions"
).split()
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand twice thrice half third quarter".split()
DROP_STOP = (
    "the a an and but or so then he his him she her it its i me my we our us you your they them their o if when whoever who what which that this these those there none no not by in on of for to at with from as is are "
    "was were be may let allah indeed verily"
).split()
#: What stands before a word that is capitalised for its place, and how such a word may open.
OPENS = r"[.!?:;\"'“‘(]$"
MARKS = r"^[\"'“‘(]"
#: What is cut off the ends of a word.
LETTER_ENDS, PLAIN_ENDS, OWNER = r"^[^A-Za-z]+|[^A-Za-z']+$", r"^[^A-Za-z0-9]+|[^A-Za-z0-9']+$", "'s$"


def consonant_skeleton(word: Column) -> Column:
    """A word's consonants, c and q as k, doubled ones once, no article and no final h."""
    w = F.regexp_replace(F.regexp_replace(F.lower(word), "^al-", ""), "[^a-z]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(w, "cq", "kk"), "[aeiouyw]", ""), r"(.)\1+", "$1"), "h$", "")


def skeletons(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), r"[^A-Za-z'-]+"), consonant_skeleton))


def tokens(text: Column) -> Column:
    """array<struct<name, plain, inner>>: each word cut to what its letters, or its letters and digits, hold, and whether it
    stands where a small word wouldn't be capitalised."""
    cut = lambda t, ends: F.regexp_replace(F.regexp_replace(t, ends, ""), OWNER, "")
    inner = lambda ts, t, i: (i > 0) & ~F.coalesce(F.get(ts, i - 1), F.lit("")).rlike(OPENS) & ~t.rlike(MARKS)
    return let(words(text), lambda ts: F.transform(ts, lambda t, i: F.struct(cut(t, LETTER_ENDS).alias("name"), cut(t, PLAIN_ENDS).alias("plain"), inner(ts, t, i).alias("inner"))))


def _names(text: Column, stop: list[str], keep: Callable[[Column], Column]) -> Column:
    """Capitalised words inside sentences that aren't of `stop` and that `keep` holds for."""
    return F.transform(F.filter(tokens(text), lambda t: t["inner"] & t["name"].rlike("^[A-Z]") & ~F.lower(t["name"]).isin(*stop) & keep(t["name"])), lambda t: t["name"])


def added_names(quote: Column, known: Column) -> Column:
    """U8: names in a quote whose skeleton, of two letters or more, isn't among the known text's."""
    new = lambda k: lambda w: (F.length(consonant_skeleton(w)) >= 2) & ~F.array_contains(k, consonant_skeleton(w))
    return let(skeletons(known), lambda k: _names(quote, CAPITAL_STOP, new(k)))


def dropped_words(ours: Column, published: Column) -> Column:
    """Numbers of ours that the published wording lacks, and names whose skeleton, or first four letters if that is short,
    it lacks."""
    low = F.filter(F.split(F.lower(F.coalesce(published, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    number = lambda w: F.lower(w).isin(*NUMBER_WORDS) | w.rlike("^[0-9]+$")

    def lacking(there: Column) -> Column:
        """there: struct<k: skeletons, p: words> of the published wording."""
        stem = lambda w: F.left(F.lower(w), F.lit(4))
        has = lambda w: F.when(F.length(consonant_skeleton(w)) >= 3, F.array_contains(there["k"], consonant_skeleton(w))).otherwise(F.exists(there["p"], lambda v: F.left(v, F.lit(4)) == stem(w)))
        numbers = F.filter(F.transform(tokens(ours), lambda t: t["plain"]), lambda w: number(w) & ~F.array_contains(there["p"], F.lower(w)))
        return F.concat(numbers, _names(ours, DROP_STOP, lambda w: ~F.lower(w).isin(*NUMBER_WORDS) & ~has(w)))

    return let(F.struct(skeletons(published).alias("k"), low.alias("p")), lacking)


def person_shift(ours: Column, published: Column) -> Column:
    """singular first-person words that the published wording adds where ours is in the plural."""
    singular = lambda t: F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(edges(r"\b(I|me|my|mine|myself)\b")), F.lit(1)))
    return F.when(F.coalesce(ours, F.lit("")).rlike(edges(r"(?i)\b(?:we|us|our|ours|ourselves)\b")), F.array_except(singular(published), singular(ours))).otherwise(F.array().cast("array<string>"))


def _plain(text: Column, least: int) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"([\p{{L}}\p{{N}}]{{{least},}})"), F.lit(1))


def removed_words(before: Column, after: Column) -> Column:
    """Words of three letters or more that a change removes, as a multiset: an occurrence beyond those that are left."""
    rest = _plain(after, 3)
    seen = lambda a, i: F.size(F.filter(F.slice(a, 1, i + 1), lambda v: v == F.get(a, i)))
    over = lambda a, r: F.filter(F.transform(a, lambda w, i: F.when(seen(a, i) > F.size(F.filter(r, lambda v: v == w)), w)), lambda w: w.isNotNull())
    return let(_plain(before, 3), lambda a: let(rest, lambda r: over(a, r)))


def removes_neighbour(before: Column, after: Column, neighbours: Column) -> Column:
    """Whether a change removes five words or more of which four fifths stand in one neighbour."""
    good = lambda cut: (F.size(_plain(after, 3)) > 0) & (F.size(cut) >= 5) & F.exists(neighbours, lambda n: let(_plain(n, 3), lambda there: F.size(F.filter(cut, lambda w: F.array_contains(there, w)))) >= 0.8 * F.size(cut))
    return let(removed_words(before, after), good)


def repeats_neighbour(before: Column, after: Column, prev: Column, nxt: Column) -> Column:
    """Whether a change makes a text begin as the row before ends, or end as the row after begins, by two to eight words,
    where it didn't before."""
    toks = lambda t: F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))

    def test(a: Column, b: Column, p: Column, n: Column) -> Column:
        head = lambda x, k: F.slice(x, F.lit(1), F.lit(k))
        tail = lambda x, k: F.slice(x, F.greatest(F.size(x) - k + 1, F.lit(1)), F.lit(k))
        found = F.lit(False)
        for k in range(2, 9):
            long = F.size(a) >= k
            found = found | (long & (F.size(p) >= k) & (tail(p, k) == head(a, k)) & (head(b, k) != head(a, k))) | (long & (F.size(n) >= k) & (head(n, k) == tail(a, k)) & (tail(b, k) != tail(a, k)))
        return found

    return let(toks(after), lambda a: let(toks(before), lambda b: let(toks(prev), lambda p: let(toks(nxt), lambda n: test(a, b, p, n)))))


def shown_text(text: Column) -> Column:
    """the paragraphs that are shown: source lines go, a quote mark before a paragraph goes, joined by a blank."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\n+"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: (p != "") & ~p.rlike("^(📖|📑|📚)"))
    return F.array_join(F.transform(kept, lambda p: F.regexp_replace(p, r"^❝\s*", "")), " ")


#: What ends a passage's text in the editions, the look-alike letter, and the editions' digits.
EDITION_END = {
    "ben": r"\s*(?:\[\d+\]|\[[০-৯]+\]|\((?:[০-৯]|আধুনিক|ইসলামিক|তাওহীদ|হাদীস একাডেমি|মুসলিম|বুখারী|আহমাদ)|(?:সহীহ|হাসান|যঈফ|দুর্বল|জাল)(?:\s*সহীহ)?\s*[ঃ:।,]|আবূ ঈসা বলেন)",
    "urd": r"\s*۱؎|\s*امام ترمذی کہتے ہیں",
    "eng": r"\s*\[\d+\]",
}
LOOK_ALIKE = ("ৰ", "র")
DIGITS = {"ben": "০১২৩৪৫৬৭৮৯", "urd": "0123456789", "eng": "0123456789"}


def edition_text(text: Column, number: Column, edition: str = "ben") -> Column:
    """an edition's text from its own number on, if more than 40 characters follow, without leading stops and with one
    form of the look-alike letter; cut where a closing note begins, past 20 characters."""
    own = F.concat(F.translate(number.cast("string"), "0123456789", DIGITS[edition]), F.lit(". "))
    at = F.instr(text, own)
    rest = F.when(number.isNotNull() & (at > 0) & (F.length(text) - at + 1 > 40), F.substring(text, at + F.length(own), F.length(text))).otherwise(text)
    clean = F.translate(F.regexp_replace(rest, r"^[\s।]+", ""), *LOOK_ALIKE)
    before = F.get(F.split(clean, EDITION_END[edition], 2), F.lit(0))
    return F.when((F.length(before) > 20) & (F.length(before) < F.length(clean)), before).otherwise(clean)


def valid_pairs(pairs: Column, ours: Column, theirs: Column) -> Column:
    """whether the pairs of phrase ends rise strictly on both sides and end on both last words."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(1))), lambda i: (F.size(pairs) == 1) | ((F.get(pairs, i)[0] > F.get(pairs, i - 1)[0]) & (F.get(pairs, i)[1] > F.get(pairs, i - 1)[1])))
    whole = F.forall(pairs, lambda p: (F.size(p) == 2) & (F.coalesce(p[0], F.lit(-1)) >= 0) & (F.coalesce(p[1], F.lit(-1)) >= 0))
    last = F.element_at(pairs, -1)
    return F.when(pairs.isNull() | (F.size(pairs) == 0), False).when(~whole, False).otherwise(rising & (last[0] == ours - 1) & (last[1] == theirs - 1))


def accepted_excerpt(excerpt: Column, full: Column, start: Column, end: Column, near: float = 0.25) -> Column:
    """the excerpt without quote marks, if it stands in the full text and begins and ends, by words, within `near` of the
    shares given; else null."""
    x = F.trim(trim_quotes(F.trim(excerpt)))
    n = F.greatest(F.size(words(full)), F.lit(1))
    at = F.instr(full, x)
    a = F.size(words(F.left(full, at - 1))) / n
    b = a + F.size(words(x)) / n
    return F.when((x != "") & (at > 0) & (F.abs(a - start) <= near) & (F.abs(b - end) <= near), x)


def take_score(said: Column, extra: Column) -> Column:
    """the share that was heard, less what was heard beyond 1.15 of the text; 1 without a hearing."""
    return F.when(said.isNull(), F.lit(1.0)).otherwise(said - F.greatest(F.lit(0.0), extra - 1.15))


def take_again(take: Column, n_words: Column, said: Column, extra: Column, before: Column, least: int = 40) -> Column:
    """whether another take is wanted: fewer than three so far, heard badly, of `least` words or more, and not without
    gain over the take before."""
    good = (said >= 0.85) & (extra <= 1.25)
    stuck = F.coalesce(take_score(said, extra) <= before + 0.02, F.lit(False))
    return F.coalesce((take < 3) & said.isNotNull() & ~good & (n_words >= least) & ~stuck, F.lit(False))


def with_default(values: Column, key: Column, default: Column) -> Column:
    """a map's value under a key, or the default."""
    return F.coalesce(F.try_element_at(values, key), default)


def term_without_source(target: Column, term: str, source: Column, phrase: str) -> Column:
    """P20: whether a term stands in the translation although the source lacks the phrase that it renders. `\\b` in either pattern is
    the edge of a word of ASCII letters."""
    return target.rlike(edges(term)) & ~F.coalesce(source, F.lit("")).rlike(edges(phrase))
