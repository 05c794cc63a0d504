"""Audience reports: views, engagement, retention, devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions.text import edges

DAY = 86400
#: The ordered cascade of user-agent patterns (flag i: letters in either case).
BOT = r"(?i)bot\b|bot/|crawl|spider|slurp|headless|preview|scanner|monitor|python|curl|wget|lighthouse|facebookexternalhit|whatsapp/|go-http|axios|node-fetch"
SYSTEMS = (("(?i)iphone|ipad|ipod", "iOS"), ("(?i)android", "Android"), ("(?i)windows", "Windows"), ("(?i)cros", "ChromeOS"), ("(?i)mac os x|macintosh", "macOS"), ("(?i)linux", "Linux"))
BROWSERS = (
    ("(?i)instagram", "Instagram app"), ("FBAN|FBAV|FB_IAB", "Facebook app"), ("(?i)snapchat", "Snapchat app"), ("SamsungBrowser", "Samsung Internet"), ("Edg(A|iOS)?/", "Edge"),
    ("OPR/|Opera", "Opera"), ("Firefox|FxiOS", "Firefox"), ("CriOS|Chrome/", "Chrome"), ("Safari", "Safari"),
)


def _first(ua: Column, cascade: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for pattern, name in reversed(cascade):
        out = F.when(ua.rlike(pattern), name).otherwise(out)
    return out


def classify_agent(df: DataFrame, ua: str) -> DataFrame:
    """Bot, os, device and browser of a user agent."""
    u = F.coalesce(F.col(ua), F.lit(""))
    tablet = u.rlike("(?i)ipad|tablet") | (u.rlike("(?i)android") & ~u.rlike("(?i)mobile"))
    device = F.when(tablet, "Tablet").when(u.rlike("(?i)mobi|iphone|ipod|android"), "Phone").otherwise("Computer")
    return df.withColumns({"bot": u.rlike(edges(BOT)), "os": _first(u, SYSTEMS, "Other"), "device": device, "browser": _first(u, BROWSERS, "Other")})


def zone_day(ts: Column, zone: str = "Asia/Riyadh") -> Column:
    """the day in a fixed zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def clean_views(df: DataFrame) -> DataFrame:
    """Page on the allow-list, source tag of word characters up to 24, device pattern; else null."""
    tag = F.left(F.regexp_replace(F.lower("src"), r"[^\w-]", ""), F.lit(24))
    return df.withColumns({
        "page": F.when(F.col("page").isin("home", "reader"), F.col("page")),
        "src": F.when(tag != "", tag),
        "dev": F.when(F.col("dev").rlike(r"^[A-Za-z0-9-]{8,64}$"), F.col("dev")),
    })


def clean_engagement(df: DataFrame, seconds: list[str], most: int = 6 * 3600) -> DataFrame:
    """Seconds rounded into [0, most]; minutes distinct, whole, in [0, 360), sorted."""
    df = df.withColumns({c: F.least(F.lit(most), F.greatest(F.lit(0), F.round(F.coalesce(F.col(c), F.lit(0.0))).cast("long"))) for c in seconds})
    return df.withColumn("heard", F.array_sort(F.array_distinct(F.filter("heard", lambda m: (m >= 0) & (m < 360)))))


def source_of(src: Column, ref: Column, browser: Column) -> Column:
    """Where a view came from."""
    return F.when(src != "", F.concat(F.lit("tag "), src)).when(ref != "", F.concat(F.lit("from "), ref)).when(browser.rlike("app$"), F.concat(F.lit("inside "), browser)).otherwise("direct")


def count_by(df: DataFrame, key: Column) -> DataFrame:
    """A1: (key, n) without null and empty keys."""
    return df.select(key.alias("key")).where("key is not null and key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def with_first_flag(df: DataFrame, who: str, ts: str, order: str) -> DataFrame:
    """Whether a row is the first of its `who`. The first row is a grouped minimum, not a sort of all rows."""
    first = df.groupBy(F.col(who).alias("_who")).agg(F.min(F.struct(ts, order)).alias("_first"))
    return df.join(first, F.col(who) == F.col("_who")).withColumn("is_new", F.struct(ts, order) == F.col("_first")).drop("_who", "_first")


def daily(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A2: (day, views, new_visitors, bots) of views with is_new and bot flags."""
    return df.groupBy(zone_day(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_if("is_new").alias("new_visitors"), F.count_if("bot").alias("bots"))


def top_per_day(df: DataFrame, place: str, ts: str = "ts", k: int = 3) -> DataFrame:
    """Each day's k most frequent places, ties by name."""
    n = df.where(F.col(place).isNotNull()).groupBy(zone_day(F.col(ts)).alias("day"), place).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.col("n").desc(), place)).cast("long")).where(F.col("rank") <= k)


def places(df: DataFrame, outer: str, inner: str, now: Column, ts: str = "ts", days: int = 7) -> DataFrame:
    """A3, P25: counts by outer and inner place and by outer alone (inner null), of all time and the last days."""
    week = F.count_if(F.col(ts) >= now - F.make_interval(days=F.lit(days)))
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), week.alias("week"), F.grouping_id().alias("level")).where("level < 3")


def first_seen(df: DataFrame, place: str, ts: str = "ts") -> DataFrame:
    """A4: when each place was first seen."""
    return df.groupBy(place).agg(F.min(ts).alias("first_ts"))


def fold_engagement(df: DataFrame, view: str, ts: str = "ts") -> DataFrame:
    """A5: snapshots of a view folded to one row: maxima of scalars, the last set language, the union of minutes."""
    return df.groupBy(view).agg(
        F.max("open_s").alias("open_s"), F.max("played_s").alias("played_s"), F.max("depth").alias("depth"),
        F.max_by("lang", F.when(F.col("lang").isNotNull(), F.struct(ts, "event_id"))).alias("lang"),
        F.array_sort(F.collect_set("minute")).alias("heard"), F.count(F.lit(1)).alias("snapshots"),
    )


def per_entry(views: DataFrame, entry: str) -> DataFrame:
    """Views, devices, medians and shares of each entry, from folded views."""
    played = F.col("played_s") >= 5
    return views.groupBy(entry).agg(
        F.count(F.lit(1)).alias("views"), F.count_distinct("dev").alias("devices"), F.median("open_s").alias("median_open"),
        F.count_if(played).alias("played"), F.median(F.when(played, F.col("played_s"))).alias("median_played"),
        F.count_if(played & (F.col("max_pos") >= 0.9 * F.col("dur"))).alias("finished"), F.count_if(F.col("depth") >= 90).alias("read_to_end"),
    )


def retention(heard: DataFrame, entry: str, listener: str, minute: str) -> DataFrame:
    """(entry, minute, listeners, n): of an entry's listeners, how many heard each minute, gaps filled with 0."""
    per = heard.select(entry, listener, minute).distinct().groupBy(entry, minute).agg(F.count(F.lit(1)).alias("n"))
    who = heard.groupBy(entry).agg(F.count_distinct(listener).alias("listeners"), F.max(minute).alias("_last"))
    every = who.withColumn(minute, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    return every.join(per, [entry, minute], "left").select(entry, minute, "listeners", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stops(curve: DataFrame, entry: str, minute: str) -> DataFrame:
    """The first minute with fewer than half the listeners, and the largest drop between minutes."""
    s = curve.withColumn("share", F.col("n") / F.col("listeners"))
    s = s.withColumn("drop", F.lag("share").over(Window.partitionBy(entry).orderBy(minute)) - F.col("share"))
    return s.groupBy(entry).agg(F.min(F.when(F.col("share") < 0.5, F.col(minute))).alias("half"), F.max_by(minute, F.when(F.col("drop") > 0, F.struct("drop", -F.col(minute)))).alias("drop_at"), F.max(F.when(F.col("drop") > 0, F.col("drop"))).alias("drop"))


def returning(df: DataFrame, who: str, ts: str = "ts") -> DataFrame:
    """Devices by the number of days on which they came."""
    days = df.groupBy(who).agg(F.count_distinct(zone_day(F.col(ts))).alias("days"))
    return days.groupBy("days").agg(F.count(F.lit(1)).alias("devices"))


def hours(df: DataFrame, ts: str = "ts", zone: str = "Asia/Riyadh") -> DataFrame:
    """Views by weekday and hour in the zone."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    return df.groupBy(F.dayofweek(local).cast("long").alias("weekday"), F.hour(local).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def headline(df: DataFrame, now: Column, who: str, ts: str = "ts") -> DataFrame:
    """Views and distinct visitors of the last day, the last week and all time."""
    last = lambda days: F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return df.agg(F.count_if(last(1)).alias("views_1"), F.count_if(last(7)).alias("views_7"), F.count(F.lit(1)).alias("views"), F.count_distinct(who).alias("visitors"), F.count_distinct(F.when(last(7), F.col(who))).alias("visitors_7"))


def rate_limited(df: DataFrame, who: str, ts: str = "ts", most: int = 5, seconds: int = 600) -> DataFrame:
    """R5 in batch: with `allowed`: at most `most` rows of one sender, refused ones included, in any trailing window."""
    w = Window.partitionBy(who).orderBy(F.unix_micros(F.col(ts))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("allowed", F.count(F.lit(1)).over(w) <= most)


def daily_sketches(rows: DataFrame, day: Column, ident: Column, log_k: int = 12) -> DataFrame:
    """(day, sketch, n): A22. A sketch of the distinct ids of each day, as bytes of a bounded size, and the rows; null ids don't count. Sketches of days that are
    over are kept as a table, and merged for any span of days without reading rows again."""
    return rows.groupBy(day.alias("day")).agg(F.hll_sketch_agg(ident, log_k).alias("sketch"), F.count(ident).alias("n"))


def distinct_over(sketches: DataFrame, days: int) -> DataFrame:
    """(day, ids): A22, S13. About how many distinct ids the `days` days up to each day have: each day's sketch is sent to the days
    that it counts for and merged there. The standard error of 12 bits is 1.6 %."""
    sent = sketches.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_i"), "day", "sketch").select(F.date_add("day", F.col("_i")).alias("day"), "sketch")
    merged = sent.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("ids"))
    return merged.join(sketches.select("day"), "day", "left_semi")
