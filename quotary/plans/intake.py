"""Queries of what comes in: views, engagement, feedback and entries, as they are kept or turned away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.operators import audience
from quotary.operators import intake as I
from quotary.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def checked_views(spark: SparkSession, d: str) -> DataFrame:
    """Events as views: pages off the list, tags with other characters, devices of another form."""
    page = F.when(F.col("event_type") == "view", "home").when(F.col("event_type") == "click", "reader").otherwise(F.col("event_type"))
    v = _events(spark, d).select("event_id", page.alias("page"), F.concat(F.lit("Tag "), F.upper("event_type"), F.lit("!"), F.repeat(F.lit("x"), F.col("k").cast("int"))).alias("src"), F.left(F.md5(F.col("event_id").cast("string")), F.col("k").cast("int")).alias("dev"))
    return audience.clean_views(v).groupBy("page", "src").agg(F.count(F.lit(1)).alias("n"), F.count("dev").alias("devices"))


def engagement_kept(spark: SparkSession, d: str) -> DataFrame:
    """Events as engagement snapshots: negative and very large seconds, minutes that are no whole ones, unknown tracks, ids of another form."""
    k, v = F.col("k").cast("double"), F.col("value")
    snap = _events(spark, d).select(
        "event_id", F.when(F.col("event_id") % 11 == 0, F.lit("XYZ")).otherwise(F.left(F.md5(F.col("event_id").cast("string")), F.lit(12))).alias("id"),
        (v * 100 - 1500).alias("open_s"), (v * 1000).alias("played_s"), (v / 3).alias("max_pos"), F.when(F.col("k") % 4 > 0, v).otherwise(0.2).alias("dur"), (k * 3).alias("depth"), k.alias("copies"), (v * 30).alias("refs"),
        F.when(F.col("k") % 2 == 0, "ur").otherwise("zz").alias("lang"), F.create_map(F.lit("imam"), v, F.lit("zz"), v, F.lit("en"), F.when(F.col("k") % 3 > 0, v * 7)).alias("voices"), F.create_map(F.lit("bn"), -v).alias("durs"),
        F.create_map(F.lit("imam"), F.array(k, k / 2, k * 9, k, F.lit(None), k - 5), F.lit("zz"), F.array(k)).alias("heard"),
    )
    e = I.engagement(snap)
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ";")
    heard = F.array_join(F.transform(F.map_entries("heard"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(F.transform(x["value"], lambda m: m.cast("string")), ","))), ";")
    return e.select("event_id", "open_s", "played_s", "max_pos", "dur", "depth", "copies", "refs", "lang", text("voices").alias("voices"), text("durs").alias("durs"), heard.alias("heard"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    message = F.when(F.col("turn") % 7 == 3, F.lit(" \n")).otherwise(F.concat(F.lit("\n "), "text"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), message.alias("message"), F.when(F.col("turn") % 3 > 0, F.concat("role", F.repeat(F.lit("n"), 70))).alias("name"), F.concat(F.col("role"), F.lit("@x")).alias("contact"), F.lit("").alias("page"), F.lit("agent").alias("agent"), F.when(F.col("turn") % 4 > 0, F.col("turn") % 2 == 0).alias("public"), F.when(F.col("turn") % 5 == 4, "http://x").alias("website"))


def feedback_kept(spark: SparkSession, d: str) -> DataFrame:
    """Turns as messages: those of blanks alone and those with the hidden field filled in go, texts are cut, empty ones null."""
    return I.feedback(_messages(spark, d)).select("ts", F.length("message").cast("long").alias("n"), F.md5("message").alias("digest"), F.length("name").cast("long").alias("name"), "page", "public")


def shown_comments(spark: SparkSession, d: str) -> DataFrame:
    """The newest public messages without those that are hidden."""
    kept = I.feedback(_messages(spark, d))
    return I.comments(kept, kept.where("ts % 9 = 0").select("ts")).select("ts", F.md5("message").alias("digest"), F.left("name", F.lit(4)).alias("name"))


def checked_entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages as entries: named by their host, with their path as slug, and some with their address for media."""
    p = table(spark, d, "pages")
    slug = F.translate(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), "/", "-")
    e = p.select("page_id", F.when(F.col("page_id") % 13 > 0, F.regexp_extract("url", "//([^/]+)/", 1)).alias("folder"), slug.alias("slug"), F.when(F.col("page_id") % 17 > 0, F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/"))).alias("media_url"), F.lit("").alias("note"), F.array(F.col("url"), F.lit(None)).alias("old_slugs"), F.lit(None).cast("boolean").alias("featured"))
    return I.entries(e).select("page_id", "reject", F.md5("title").alias("title"), "note", F.size("old_slugs").alias("old"), "featured")


QUERIES = {f.__name__: f for f in (checked_views, engagement_kept, feedback_kept, shown_comments, checked_entries)}

_SEC = lambda x, most=I.MOST_SECONDS: f"least(CASE WHEN ({x}) >= 0 THEN floor(least({x}, {I.MOST_SECONDS}.0::DOUBLE) + 0.5) ELSE 0 END, {most})::BIGINT"
_E = "e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"
_M = "m AS (SELECT conv_id * 100 + turn AS ts, CASE WHEN turn % 7 = 3 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g')[:2000] END AS message, CASE WHEN turn % 3 > 0 THEN (role || repeat('n', 70))[:60] END AS name, coalesce(CASE WHEN turn % 4 > 0 THEN turn % 2 = 0 END, false) AS public FROM conversations WHERE turn % 5 <> 4)"
SQL = {
    "checked_views": f"""WITH {_E}, v AS (SELECT CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'reader' END AS page, left('tag' || regexp_replace(event_type, '\\W', '', 'g') || repeat('x', k::INTEGER), 24) AS src, CASE WHEN k >= 8 THEN least(k, 32) END AS dev FROM e)
SELECT page, src, count(*)::BIGINT AS n, count(dev)::BIGINT AS devices FROM v GROUP BY ALL""",
    "engagement_kept": f"""WITH {_E} SELECT event_id, {_SEC('value * 100 - 1500')} AS open_s, {_SEC('value * 1000')} AS played_s, {_SEC('value / 3')} AS max_pos, nullif({_SEC('CASE WHEN k % 4 > 0 THEN value ELSE 0.2::DOUBLE END')}, 0) AS dur, {_SEC('k * 3', 100)} AS depth, {_SEC('k', 50)} AS copies, {_SEC('value * 30', 500)} AS refs,
CASE WHEN k % 2 = 0 THEN 'ur' ELSE 'en' END AS lang, CASE WHEN k % 3 > 0 THEN 'en=' || {_SEC('value * 7')} || ';' ELSE '' END || 'imam=' || {_SEC('value')} AS voices, 'bn=' || {_SEC('-value')} AS durs,
'imam=' || array_to_string(list_sort(list_distinct(list_transform(list_filter([k::DOUBLE, k / 2.0::DOUBLE, k * 9.0::DOUBLE, k - 5.0::DOUBLE], lambda m: m = floor(m) AND m >= 0 AND m < 360), lambda m: m::INTEGER))), ',') AS heard FROM e WHERE event_id % 11 <> 0""",
    "feedback_kept": f"WITH {_M} SELECT ts, length(message)::BIGINT AS n, md5(message) AS digest, length(name)::BIGINT AS name, NULL::VARCHAR AS page, public FROM m WHERE message <> ''",
    "shown_comments": f"WITH {_M} SELECT ts, md5(message) AS digest, name[:4] AS name FROM m WHERE message <> '' AND public AND ts % 9 <> 0 ORDER BY ts DESC LIMIT {I.SHOWN}",
    "checked_entries": """WITH p AS (SELECT page_id, CASE WHEN page_id % 13 > 0 THEN regexp_extract(url, '//([^/]+)/', 1) END AS folder, replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/', '-') AS slug, CASE WHEN page_id % 17 > 0 THEN nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') END AS title, CASE WHEN page_id % 3 = 0 THEN url || '/' END AS media FROM pages)
SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(folder, '^[A-Za-z0-9_-][A-Za-z0-9_.-]{0,199}$'), false) THEN 'folder' WHEN NOT regexp_matches(slug, '^[a-z0-9-]{1,80}$') THEN 'slug' WHEN title IS NULL THEN 'title' WHEN media IS NOT NULL AND NOT regexp_matches(media, '^https://[^\\s"''<>]+/$') THEN 'media_url' END AS reject, md5(title) AS title, NULL::VARCHAR AS note, 1 AS old, false AS featured FROM p""",
}
