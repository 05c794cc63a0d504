"""Queries of the audience reports over events: a user is a device, the event type a page, the `k` of props a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import audience as A
from quotary.sources.tables import table


def now():
    """The report's moment, a parameter of every rolling count."""
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """Events as views; the place is props.k, errors are bots."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.withColumns({"k": k, "city": F.concat(F.lit("c"), k), "country": F.concat(F.lit("z"), k % 10), "bot": F.col("event_type") == "error", "hosting": k % 17 == 0})


def daily_views(spark: SparkSession, d: str) -> DataFrame:
    """A2, W19, P11, F29."""
    return A.daily(A.with_first_flag(views(spark, d), "user_id", "ts", "event_id"))


def counted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the allow-list, by count."""
    page = F.when(F.col("event_type").isin("view", "purchase"), F.when(F.col("event_type") == "view", "home").otherwise("reader"))
    return A.count_by(views(spark, d), page)


def places(spark: SparkSession, d: str) -> DataFrame:
    """A3, P25: countries and cities, all time and last week, without data centres."""
    return A.places(views(spark, d).where("not hosting"), "country", "city", now()).drop("level")


def new_places(spark: SparkSession, d: str) -> DataFrame:
    """Places, a city and a user's own part of it, by when they were first seen, in the last 29 days of the report."""
    v = views(spark, d).withColumn("place", F.concat_ws("-", "city", "user_id"))
    return A.first_seen(v, "place").where(F.col("first_ts") >= now() - F.make_interval(days=F.lit(29))).select("place", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


def top_places(spark: SparkSession, d: str) -> DataFrame:
    """T2, J17."""
    return A.top_per_day(views(spark, d), "city")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Events as engagement snapshots of a view, one view a user and day."""
    v = views(spark, d)
    return v.withColumns({
        "view": F.concat_ws("-", "user_id", A.zone_day(F.col("ts")).cast("string")), "open_s": F.round("value").cast("long"), "played_s": F.when(F.col("event_type") == "click", F.round("value").cast("long")),
        "depth": F.col("k"), "lang": F.when(F.col("k") % 3 != 0, F.concat(F.lit("l"), F.col("k") % 4)), "minute": F.floor(F.col("value")).cast("long"),
    })


def fold_engagement(spark: SparkSession, d: str) -> DataFrame:
    """A5, R8, P14."""
    return A.fold_engagement(snapshots(spark, d), "view").select("view", "open_s", "played_s", "depth", "lang", F.array_join(F.transform("heard", lambda x: x.cast("string")), ",").alias("heard"), "snapshots")


def per_entry(spark: SparkSession, d: str) -> DataFrame:
    """Engagement by entry, an entry being the user modulo 12."""
    s = snapshots(spark, d)
    folded = s.groupBy("view", (F.col("user_id") % 12).alias("entry")).agg(F.first("user_id").alias("dev"), F.max("open_s").alias("open_s"), F.max("played_s").alias("played_s"), F.max("k").alias("max_pos"), F.lit(100).alias("dur"), F.max("depth").alias("depth"))
    return A.per_entry(folded, "entry")


def curve(spark: SparkSession, d: str) -> DataFrame:
    return A.retention(snapshots(spark, d).where("minute < 360").withColumn("entry", F.col("user_id") % 12), "entry", "user_id", "minute")


def retention(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return curve(spark, d)


def retention_stops(spark: SparkSession, d: str) -> DataFrame:
    """A7, W20."""
    return A.stops(curve(spark, d), "entry", "minute").select("entry", "half", "drop_at", F.round("drop", 6).alias("drop"))


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Bots out."""
    return A.hours(views(spark, d).where("not bot"))


def returning_users(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return A.returning(views(spark, d), "user_id")


def headline(spark: SparkSession, d: str) -> DataFrame:
    """A10, A22, R11."""
    return A.headline(views(spark, d), now(), "user_id")


def totals_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Running totals and first-seen of each place."""
    return views(spark, d).groupBy("country").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("user_id").alias("ids"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


def median_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The exact median, and the 95th percentile by index."""
    order = Window.partitionBy("event_type").orderBy("value", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type"))
    r = table(spark, d, "events").withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", n)
    p = F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * 95 / 100), F.col("_n") - 1), F.col("value")))
    return r.groupBy("event_type").agg(F.median("value").alias("median"), p.alias("p95"))


def zscores(spark: SparkSession, d: str) -> DataFrame:
    """Each event's value against its type's mean and deviation, averaged over a day to six places."""
    s = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = table(spark, d, "events").join(s, "event_type").withColumn("z", (F.col("value") - F.col("m")) / (F.col("s") + F.lit(1e-9)))
    return z.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.max("z"), 6).alias("max_z"), F.count_if(F.col("z") > 1).alias("high"))


def frame_features(spark: SparkSession, d: str) -> DataFrame:
    """Statistics by user where there is evidence enough: 20 values at least."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("mid"), F.round(F.percentile("value", 0.9) - F.percentile("value", 0.1), 6).alias("range"))
    return g.where("n >= 20")


def cost_totals(spark: SparkSession, d: str) -> DataFrame:
    """Usage by kind, with the grand total."""
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels by severity, ordered."""
    sev = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    return table(spark, d, "labels").groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)).orderBy("rank")


def verdict(spark: SparkSession, d: str) -> DataFrame:
    """Proportions and their verdict, by user modulo 12."""
    v = views(spark, d).groupBy((F.col("user_id") % 12).alias("entry")).agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("value") >= 10).alias("heard"), F.count_if(F.col("value").between(10, 60)).alias("on_time"))
    good = (F.col("heard") >= 0.6 * F.col("asked")) & (F.col("on_time") >= 0.75 * F.col("heard"))
    return v.withColumn("good", good)


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """20 evenly spaced events of each type."""
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type"))
    r = table(spark, d, "events").withColumn("_i", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1).withColumn("_n", n)
    picks = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select("event_type", F.col("k").cast("long").alias("k"), F.floor((F.col("k") + 0.5) * F.col("n") / 20).alias("_i"))
    return r.join(picks, ["event_type", "_i"]).select("event_type", "k", "event_id")


def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """R5 in batch: five events a user in ten hours."""
    r = A.rate_limited(views(spark, d), "user_id", seconds=36000)
    return r.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def traffic_sources(spark: SparkSession, d: str) -> DataFrame:
    """The source of each view by a chain of cases."""
    v = views(spark, d).withColumns({"src": F.when(F.col("k") % 5 == 0, F.concat(F.lit("s"), F.col("k"))), "ref": F.when(F.col("k") % 5 == 1, F.concat(F.lit("r"), F.col("k"))), "browser": F.when(F.col("k") % 5 == 2, "Facebook app").otherwise("Chrome")})
    return v.groupBy(A.source_of(F.col("src"), F.col("ref"), F.col("browser")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def shown_shares(spark: SparkSession, d: str) -> DataFrame:
    """durations and shares as they are shown."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.round("value").cast("long")).alias("s"), F.count_if(F.col("event_type") == "view").alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("user_id", X.duration(F.col("s").cast("double")).alias("time"), X.share(F.col("a"), F.col("b")).alias("share"))


QUERIES = {f.__name__: f for f in (daily_views, counted_pages, places, new_places, top_places, fold_engagement, per_entry, retention, retention_stops, hours, returning_users, headline, totals_snapshot, median_by_type, zscores, frame_features, cost_totals, severity_counts, verdict, even_sample, rate_limited, traffic_sources, shown_shares)}

_V = """v AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
w AS (SELECT *, 'c' || k AS city, 'z' || (k % 10) AS country, event_type = 'error' AS bot, k % 17 = 0 AS hosting, (ts + INTERVAL 3 HOUR) AS local, (ts + INTERVAL 3 HOUR)::DATE AS day FROM v)"""
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_S = f"""{_V}, s AS (SELECT *, user_id || '-' || day AS view, round(value)::BIGINT AS open_s, CASE WHEN event_type = 'click' THEN round(value)::BIGINT END AS played_s, k AS depth,
CASE WHEN k % 3 <> 0 THEN 'l' || (k % 4) END AS lang, floor(value)::BIGINT AS minute FROM w)"""
_R = f"""{_S}, h AS (SELECT DISTINCT user_id % 12 AS entry, user_id, minute FROM s WHERE minute < 360), who AS (SELECT entry, count(DISTINCT user_id)::BIGINT AS listeners, max(minute) AS last FROM h GROUP BY entry),
ev AS (SELECT entry, listeners, unnest(range(0, last + 1)) AS minute FROM who), per AS (SELECT entry, minute, count(*)::BIGINT AS n FROM h GROUP BY ALL),
curve AS (SELECT ev.entry, ev.minute, listeners, coalesce(n, 0)::BIGINT AS n FROM ev LEFT JOIN per ON ev.entry = per.entry AND ev.minute = per.minute)"""

SQL = {
    "daily_views": f"WITH {_V}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_new FROM w) SELECT day, count(*)::BIGINT AS views, count(*) FILTER (WHERE is_new)::BIGINT AS new_visitors, count(*) FILTER (WHERE bot)::BIGINT AS bots FROM f GROUP BY day",
    "counted_pages": "SELECT CASE event_type WHEN 'view' THEN 'home' ELSE 'reader' END AS key, count(*)::BIGINT AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1",
    "places": f"WITH {_V} SELECT country, city, count(*)::BIGINT AS n, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 7 DAY)::BIGINT AS week FROM w WHERE NOT hosting GROUP BY GROUPING SETS ((country, city), (country))",
    "new_places": f"WITH {_V} SELECT city || '-' || user_id AS place, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM w GROUP BY 1 HAVING min(ts) >= {_NOW} - INTERVAL 29 DAY",
    "top_places": f"WITH {_V}, n AS (SELECT day, city, count(*)::BIGINT AS n FROM w WHERE city IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, city) AS rank FROM n) WHERE rank <= 3",
    "fold_engagement": f"WITH {_S} SELECT view, max(open_s) AS open_s, max(played_s) AS played_s, max(depth) AS depth, arg_max(lang, (ts, event_id)) FILTER (WHERE lang IS NOT NULL) AS lang, array_to_string(list_sort(list(DISTINCT minute)), ',') AS heard, count(*)::BIGINT AS snapshots FROM s GROUP BY view",
    "per_entry": f"""WITH {_S}, f AS (SELECT view, user_id % 12 AS entry, min(user_id) AS dev, max(open_s) AS open_s, max(played_s) AS played_s, max(k) AS max_pos, max(depth) AS depth FROM s GROUP BY view, user_id % 12)
SELECT entry, count(*)::BIGINT AS views, count(DISTINCT dev)::BIGINT AS devices, median(open_s)::DOUBLE AS median_open, count(*) FILTER (WHERE played_s >= 5)::BIGINT AS played, median(played_s) FILTER (WHERE played_s >= 5)::DOUBLE AS median_played,
count(*) FILTER (WHERE played_s >= 5 AND max_pos >= 90)::BIGINT AS finished, count(*) FILTER (WHERE depth >= 90)::BIGINT AS read_to_end FROM f GROUP BY entry""",
    "retention": f"WITH {_R} SELECT * FROM curve",
    "retention_stops": f"""WITH {_R}, cs AS (SELECT *, n::DOUBLE / listeners AS share FROM curve), dr AS (SELECT *, lag(share) OVER (PARTITION BY entry ORDER BY minute) - share AS drop_ FROM cs)
SELECT entry, min(minute) FILTER (WHERE share < 0.5) AS half, arg_max(minute, (drop_, -minute)) FILTER (WHERE drop_ > 0) AS drop_at, round(max(drop_) FILTER (WHERE drop_ > 0), 6) AS drop FROM dr GROUP BY entry""",
    "hours": f"WITH {_V} SELECT (dayofweek(local) + 1)::BIGINT AS weekday, hour(local)::BIGINT AS hour, count(*)::BIGINT AS n FROM w WHERE NOT bot GROUP BY ALL",
    "returning_users": f"WITH {_V}, u AS (SELECT user_id, count(DISTINCT day)::BIGINT AS days FROM w GROUP BY user_id) SELECT days, count(*)::BIGINT AS devices FROM u GROUP BY days",
    "headline": f"SELECT count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 1 DAY)::BIGINT AS views_1, count(*) FILTER (WHERE ts >= {_NOW} - INTERVAL 7 DAY)::BIGINT AS views_7, count(*)::BIGINT AS views, count(DISTINCT user_id)::BIGINT AS visitors, count(DISTINCT user_id) FILTER (WHERE ts >= {_NOW} - INTERVAL 7 DAY)::BIGINT AS visitors_7 FROM events",
    "totals_snapshot": f"WITH {_V} SELECT country, count(*)::BIGINT AS total, count(DISTINCT user_id)::BIGINT AS ids, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM w GROUP BY country",
    "median_by_type": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, median(value) AS median, max(value) FILTER (WHERE i = least((n * 95) // 100, n - 1)) AS p95 FROM r GROUP BY event_type",
    "zscores": "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), z AS (SELECT event_type, ts::DATE AS day, (value - m) / (s + 1e-9) AS z FROM events JOIN s USING (event_type)) SELECT event_type, day, round(max(z), 6) AS max_z, count(*) FILTER (WHERE z > 1)::BIGINT AS high FROM z GROUP BY ALL",
    "frame_features": "SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS mid, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS range FROM events GROUP BY user_id HAVING count(*) >= 20",
    "cost_totals": "SELECT event_type, count(*)::BIGINT AS calls, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type)",
    "severity_counts": "WITH s AS (SELECT CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS severity FROM labels) SELECT severity, count(*)::BIGINT AS n, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::INTEGER AS rank FROM s GROUP BY severity",
    "verdict": "WITH v AS (SELECT user_id % 12 AS entry, count(*)::BIGINT AS asked, count(*) FILTER (WHERE value >= 10)::BIGINT AS heard, count(*) FILTER (WHERE value BETWEEN 10 AND 60)::BIGINT AS on_time FROM events GROUP BY 1) SELECT *, heard >= 0.6 * asked AND on_time >= 0.75 * heard AS good FROM v",
    "even_sample": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), k AS (SELECT unnest(range(0, 20)) AS k) SELECT event_type, k::BIGINT AS k, event_id FROM r JOIN k ON i = floor((k + 0.5) * n / 20)",
    "rate_limited": "WITH r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '35999.999999' SECOND PRECEDING AND CURRENT ROW) <= 5 AS ok FROM events) SELECT user_id, count(*) FILTER (WHERE ok)::BIGINT AS allowed, count(*) FILTER (WHERE NOT ok)::BIGINT AS refused FROM r GROUP BY user_id",
    "traffic_sources": f"WITH {_V} SELECT CASE k % 5 WHEN 0 THEN 'tag s' || k WHEN 1 THEN 'from r' || k WHEN 2 THEN 'inside Facebook app' ELSE 'direct' END AS source, count(*)::BIGINT AS n FROM w GROUP BY 1",
    "shown_shares": """WITH g AS (SELECT user_id, sum(round(value)::BIGINT) AS s, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) AS b FROM events GROUP BY user_id),
m AS (SELECT *, floor(s / 60.0) AS w, s / 60.0 - floor(s / 60.0) AS p FROM g), t AS (SELECT *, w::BIGINT * 10 + (((p * 4503599627370496)::BIGINT * 20 + 4503599627370496) >> 53) AS n FROM m)
SELECT user_id, CASE WHEN s < 60 THEN s::BIGINT || ' s' WHEN s < 600 THEN n // 10 || '.' || n % 10 || ' min' ELSE w::BIGINT + CASE WHEN p >= 0.5 THEN 1 ELSE 0 END || ' min' END AS time, floor(100.0 * a / b + 0.5)::BIGINT || '%' AS share FROM t""",
}
