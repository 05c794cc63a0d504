"""What comes in from outside, checked and cut to shape: views, engagement, feedback, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds and minutes of an engagement at most, its other limits, the form of its id, tracks and languages.
MOST_SECONDS, MOST_MINUTES = 6 * 3600, 360
LIMITS = {"depth": 100, "copies": 50, "refs": 500}
VIEW_ID = r"^[0-9a-f]{12}$"
LANGUAGES = ("en", "ur", "bn")
TRACKS = ("imam", *LANGUAGES)
#: Lengths to which what a visitor writes is cut, and comments that are shown.
LENGTHS = {"message": 2000, "contact": 200, "name": 60, "page": 120, "agent": 200}
SHOWN = 200
#: The forms of an entry's folder, slug and media address, and the lengths of its texts and lists.
FOLDER, SLUG, MEDIA = r"^[A-Za-z0-9_-][A-Za-z0-9_.-]{0,199}$", r"^[a-z0-9-]{1,80}$", r"^https://[^\s\"'<>]+/$"
ENTRY_TEXTS, TEXT_LENGTH, LIST_LENGTH = ("title", "speaker", "place", "place_native", "maps_url", "date", "audio", "page", "note"), 2000, 50


def seconds(x: Column, most: int = MOST_SECONDS) -> Column:
    """A number rounded half up into [0, MOST_SECONDS], 0 for what is none, and `most` at most."""
    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0)
    return F.least(F.when(sound, F.floor(F.least(x, F.lit(float(MOST_SECONDS))) + 0.5)).otherwise(0), F.lit(most)).cast("long")


def minutes(x: Column) -> Column:
    """The whole minutes of [0, MOST_MINUTES) in an array, distinct and sorted; none for null."""
    whole = F.filter(F.coalesce(x, F.array().cast("array<double>")), lambda m: m.isNotNull() & (m == F.floor(m)) & (m >= 0) & (m < MOST_MINUTES))
    return F.array_sort(F.array_distinct(F.transform(whole, lambda m: m.cast("int"))))


def engagement(df: DataFrame) -> DataFrame:
    """Snapshots (id, open_s, played_s, max_pos, dur, depth, copies, refs as doubles; lang; voices and durs, maps of doubles, and heard, a map of
    arrays of doubles, by track) within their limits. Rows whose id has another form go; tracks that aren't known or have no value go; an unknown language is
    the first one; a length of 0 is none. Columns that aren't named stay."""
    known = lambda m, f: F.transform_values(F.map_filter(F.col(m), lambda k, v: k.isin(*TRACKS) & v.isNotNull()), lambda _, v: f(v))
    dur = seconds(F.col("dur"))
    rows = df.where(F.col("id").rlike(VIEW_ID))
    return rows.withColumns({
        **{c: seconds(F.col(c)) for c in ("open_s", "played_s", "max_pos")},
        **{c: seconds(F.col(c), most) for c, most in LIMITS.items()},
        "dur": F.when(dur > 0, dur), "lang": F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(LANGUAGES[0]),
        "voices": known("voices", seconds), "durs": known("durs", seconds), "heard": known("heard", minutes),
    })


def feedback(df: DataFrame, honeypot: str = "website") -> DataFrame:
    """Messages (message, name, contact, page, agent, public, `honeypot`) as they are kept: trimmed and cut, what is empty null. Those without a message go, and those
    with the field filled in that only bots see. Only what says so is public. Columns that aren't named stay."""
    cut = lambda c: F.left(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")), F.lit(LENGTHS[c]))
    kept = df.withColumns({c: cut(c) for c in LENGTHS}).where((F.col("message") != "") & (F.coalesce(F.col(honeypot), F.lit("")) == ""))
    none = {c: F.when(F.col(c) != "", F.col(c)) for c in ("name", "contact", "page")}
    return kept.withColumns(none | {"public": F.coalesce("public", F.lit(False))}).drop(honeypot)


def comments(messages: DataFrame, hidden: DataFrame, time: str = "ts", newest: int = SHOWN) -> DataFrame:
    """(time, name, message) of the `newest` public messages whose time isn't among those of hidden(time), the latest first; of one time in the order of their
    text. How to reach their writers is never among the columns."""
    shown = messages.where("public and message <> ''").join(hidden.select(time).distinct(), time, "left_anti")
    return shown.orderBy(F.col(time).desc(), "message").limit(newest).select(time, "name", "message")


def entries(df: DataFrame) -> DataFrame:
    """Entries with `reject`: null for one that can be published, else why not. Its texts are cut and empty ones null, its lists
    (old_slugs, old_folders) cut and without nulls, and `featured` is what says so. Other columns stay."""
    form = lambda c, p: ~F.coalesce(F.col(c).rlike(p), F.lit(False))
    reject = F.when(form("folder", FOLDER), "folder").when(form("slug", SLUG), "slug").when(F.coalesce("title", F.lit("")) == "", "title")
    reject = reject.when(F.col("media_url").isNotNull() & form("media_url", MEDIA), "media_url")
    texts = {c: F.when(F.col(c) != "", F.left(c, F.lit(TEXT_LENGTH))) for c in ENTRY_TEXTS if c in df.columns}
    lists = {c: F.slice(F.array_compact(c), 1, LIST_LENGTH) for c in ("old_slugs", "old_folders") if c in df.columns}
    return df.withColumns({"reject": reject, **texts, **lists, "featured": F.coalesce("featured", F.lit(False))})

