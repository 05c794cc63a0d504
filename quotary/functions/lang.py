"""Language packs: the word keys, patterns and lists that the matching operators take as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quotary.functions import text as X


def latin(text: Column) -> Column:
    return X.latin_key(text)


@dataclass(frozen=True)
class Language:
    """D3: what differs between languages. `deep` is the key by which words are compared, `light` the milder one that patterns
    are written for, `spelling` the one that keeps the written letters. Patterns match whole keys of words."""

    name: str
    deep: Callable[[Column], Column]
    light: Callable[[Column], Column]
    spelling: Callable[[Column], Column]
    citing: str
    negation: str
    plea: str
    plea_opener: str
    and_prefix: str
    clitic: str
    sentence_end: str
    reported: str
    opener: tuple = ()  # (group, passage) of the ritual opener
    stop: tuple[str, ...] = ()
    formula: tuple[str, ...] = ()
    deliberate: str = "(?!)"
    phrases: tuple[str, ...] = ()
    rituals: tuple[str, ...] = ()


#: By language the words of another faith, old literary forms and forms to avoid with those to use, and the scripts.
TERM_RULES = {
    "bn": {"forbidden": ["ঈশ্বর", "ভগবান", "স্বর্গ", "নরক", "ধর্মভীরু"], "old": ["িয়াছ", "িতেছ", "তাহাদের", "াদিগ"], "avoid": {"তায়ালা": "তাআলা", "সর্দার": "নেতা"}},
}
SCRIPTS = {"bn": "Bengali", "ar": "Arabic", "ur": "Arabic", "en": "Latin", "de": "Latin", "es": "Latin", "fr": "Latin"}
#: The script's citing words, negations, pleas, clitics, stop words, formula words, fixed phrases and rituals.
ARABIC = Language(
    name="ar",
    deep=X.deep_key,
    light=X.letters_key,
    spelling=X.spelling_key,
    citing=r"^(قال|وقال|فقال|يقول|ويقول|تعالى|وتعالى|وعلا|سبحانه|وجل|قوله|وقوله|لقوله)$",
    negation=r"^[وف]?(?:لا|لن|لم)$",
    plea=r"^اللهم$",
    plea_opener=r"^و?(?:رب|ربنا)$",
    and_prefix=r"^و(?=..)",
    clitic=r"^(?:و|ف)?(?:ب|ل|ك)?(?:ال)?",
    sentence_end=r"[.!؟?:]$",
    reported=r"^(?:رواه|اخرجه|خرجه)$",
    opener=(16, 98),
    stop=("قال", "فقال", "يقول", "صلى", "الله", "لله", "بالله", "والله", "عليه", "وسلم", "رسول", "النبي", "عن", "ان", "انه", "رضي", "عنه", "عنها", "عنهما", "يا", "قالوا", "فقالوا"),
    formula=("صلي", "الله", "عليه", "وسلم", "رسول", "النبي", "قال", "يقول", "عن", "رضي", "عنه", "عنها", "اكبر", "سبحانه", "تعالي", "وتعالي", "عز", "وجل"),
    deliberate=r"(?:^| )(?:و?اللهم|يا|ربنا|اكبر|محمد|ابراهيم|احفظ|واحفظ|وانصر)(?= |$)",
    phrases=("صلى الله عليه وسلم", "صلى الله عليه وآله وسلم", "رضي الله عنه", "رضي الله عنها", "رضي الله عنهما", "رضي الله عنهم", "عز وجل", "جل جلاله", "سبحانه وتعالى", "تبارك وتعالى", "عليه السلام", "عليه الصلاة والسلام", "رحمه الله"),
)
#: The same for the Latin texts of the tables: common words stand where the script's have their formulas.
LATIN = Language(
    name="latin",
    deep=latin,
    light=latin,
    spelling=latin,
    citing=r"^(for|by|with|par|und)$",
    negation=r"^(not|no|ne|nicht|non)$",
    plea=r"^(that|that,|que|dass)$",
    plea_opener=r"^(the|la|der)$",
    and_prefix=r"^(?:d|l)'(?=..)",
    clitic=r"^(?:re|un|an)(?=...)",
    sentence_end=r"[.!?:]$",
    reported=r"^(in|from|dans|von)$",
    opener=(0, 1),
    stop=("the", "of", "and", "to", "in", "is", "that", "it", "de", "la", "le", "der", "die", "und", "el", "los"),
    formula=("the", "of", "and", "to", "in", "is", "that", "it", "de", "la", "le", "der", "die", "und", "el", "los"),
    deliberate=r"(?:^| )(?:amen)(?= |$)",
    phrases=("of the", "in the", "de la", "in der"),
)
LANGUAGES = {x.name: x for x in (ARABIC, LATIN)}


def keys(text: Column, key: Callable[[Column], Column]) -> Column:
    """Each word's key; a word's key may be empty, its position stays."""
    return F.transform(X.words(text), key)


def is_negation(word: Column, lang: Language = ARABIC) -> Column:
    """Whether the word is a negation, of its light key."""
    return lang.light(word).rlike(lang.negation)


def cites(word: Column, lang: Language = ARABIC) -> Column:
    """Whether the word introduces a quotation, of its light key."""
    return lang.light(word).rlike(lang.citing)


def strip_clitic(word: Column, lang: Language = ARABIC) -> Column:
    """the word without its prefixed particles; the word itself if nothing would be left."""
    bare = F.regexp_replace(word, lang.clitic, "")
    return F.when(bare == "", word).otherwise(bare)


def splits_phrase(light: Column, at: Column, lang: Language = ARABIC) -> Column:
    """whether a cut before word `at` (from 0) of the array of light keys falls inside a fixed phrase."""
    found = F.lit(False)
    for p in lang.phrases:
        n = len(p.split())
        want = F.transform(F.split(F.lit(p), " "), lang.light)
        for k in range(1, n):
            found = found | ((at >= k) & (at - k + n <= F.size(light)) & (F.slice(light, F.greatest(at - k + 1, F.lit(1)), n) == want))
    return found


def in_plea_sentence(raw: Column, at: Column, lang: Language = ARABIC, back: int = 30) -> Column:
    """Whether a plea stands before word `at` in its sentence, `back` words at most, with no citing word after it.

    The sentence begins after the last word before `at` that ends one."""
    lo = F.greatest(at - back, F.lit(0))
    lead = F.slice(raw, lo + 1, at - lo)
    ends = F.transform(lead, lambda w, i: F.when(w.rlike(lang.sentence_end), i + 1).otherwise(0))
    said = F.when(at > 0, F.slice(lead, F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.size(lead))).otherwise(F.array().cast("array<string>"))
    light = F.transform(said, lang.light)
    place = F.coalesce(F.array_max(F.transform(light, lambda w, i: F.when(w.rlike(lang.plea), i + 1).otherwise(0))), F.lit(0))
    return (place > 0) & ~F.exists(F.slice(light, place + 1, F.size(light)), lambda w: w.rlike(lang.citing))


def normalized(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form, Arrow batches at a time; null stays null."""

    def to_form(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    return F.pandas_udf(to_form, "string")(text)


#: The ordered replacements of the loose key of a neighbouring script.
LOOSE_STEPS = [("[ً-ٰٟٔں]", ""), ("[يى]", "ی"), ("ك", "ک"), ("[ةه]", "ہ"), (r"[^\p{L}\p{N}\s]", " ")]


def loose_words(text: Column) -> Column:
    """words of the loose key: marks dropped, look-alike letters one, letters and digits only."""
    folded = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), LOOSE_STEPS, normalized(text))
    return X.words(F.lower(folded))


def place_slug(name: Column) -> Column:
    """F32: decomposed, ASCII only, words for a place of worship dropped, dashes between words, 30 characters."""
    plain = F.lower(F.regexp_replace(normalized(name, "NFKD"), r"[^\x00-\x7f]", ""))
    dashed = F.regexp_replace(F.regexp_replace(plain, X.edges(r"\b(masjid|mosque|jami|jamia)\b"), ""), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(30))
