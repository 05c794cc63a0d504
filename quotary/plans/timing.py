"""Queries of the timing operators: a user's events in order of time are the words of one document; value is seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import timing as T
from quotary.sources.tables import table


def series(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, event_id, event_type, value, k, v): v is null where k is divisible by 3."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value", k.alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(k % 3 != 0, F.col("value")).alias("v"))


def clamped_times(spark: SparkSession, d: str) -> DataFrame:
    """Clamped times, and which given ones don't increase."""
    s = T.clamp_increasing(series(spark, d), "user_id", "event_id", "v", "t")
    back = F.coalesce(F.col("v") <= F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(False))
    return s.withColumn("back", back).select("user_id", "event_id", "t", "back")


def interpolated(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return T.interpolate(series(spark, d), "user_id", "event_id", "v", "t").select("user_id", "event_id", F.round("t", 6).alias("t"))


def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of three missing times or more."""
    return T.missing_runs(series(spark, d), "user_id", "event_id", "v", 3)


def settled(spark: SparkSession, d: str) -> DataFrame:
    """Times in hours; an event over half an hour from both neighbours goes next to its own; purchases end a sentence."""
    s = series(spark, d).withColumn("h", F.round(F.col("us") / 3.6e9, 3))
    return T.settle_lone(s, "user_id", "event_id", "h", 0.5, F.col("event_type") == "purchase", "t").select("user_id", "event_id", "t")


def segment_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Word positions of a conversation's turns."""
    c = table(spark, d, "conversations")
    return T.offsets(c, "conv_id", "turn", F.size(X.words(F.col("text")))).select("conv_id", "turn", "w_start", "w_end")


def block_ends(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return T.with_end(series(spark, d), "user_id", "event_id", "v", F.lit(999.0)).select("user_id", "event_id", "end_s")


def overlapping_blocks(spark: SparkSession, d: str) -> DataFrame:
    """An event lasts as long as its value in quarters of an hour."""
    s = series(spark, d).withColumns({"s": F.col("us"), "e": F.col("us") + F.floor(F.col("value") * 900).cast("long") * 1_000_000})
    return T.overlapping(s, "user_id", "event_id", "s", "e")


def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    """The last view before each purchase of a user."""
    s = series(spark, d)
    p = s.where("event_type = 'purchase'").select("user_id", "us", "event_id")
    v = s.where("event_type = 'view'").select("user_id", "us", "event_id")
    return T.as_of(p, v, "user_id", "us", "event_id", ["event_id"]).select("user_id", "event_id", F.col("prev_event_id").alias("view_id"))


def closest_view(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the view nearest to it, before or after."""
    s = series(spark, d)
    pick = lambda kind: s.where(F.col("event_type") == kind).select("user_id", "us", "event_id")
    return T.nearest(pick("purchase"), pick("view").withColumnRenamed("event_id", "v"), "user_id", "us", "v", "view_id").select("user_id", "event_id", "view_id")


def largest_gap(spark: SparkSession, d: str) -> DataFrame:
    """The largest pause of each user between 20 and 85 % of their events."""
    return T.largest_gap(series(spark, d), "user_id", "event_id", "us")


def remapped(spark: SparkSession, d: str) -> DataFrame:
    """Each signup inserts ten seconds before what follows."""
    s = series(spark, d).withColumn("at", F.col("us").cast("double"))
    ins = s.where("event_type = 'signup'").select("user_id", "at", F.lit(1e7).alias("len"))
    moved = T.remap_timeline(s.where("event_type <> 'signup'").select("user_id", "event_id", "at"), ins, "user_id", "at", "len", "moved")
    return moved.select("user_id", "event_id", F.col("moved").cast("long").alias("moved"))


def shifted(spark: SparkSession, d: str) -> DataFrame:
    """All times one earlier, not below 0; times of clicks are replaced by their rounded ones."""
    s = series(spark, d).select("user_id", "event_id", "event_type", F.greatest(F.lit(0.0), F.round(F.col("value") - 1, 2)).alias("t"))
    new = s.where("event_type = 'click'").withColumn("t", F.floor("t").cast("double"))
    return s.join(new.select("event_id"), "event_id", "left_anti").unionByName(new, allowMissingColumns=True).select("user_id", "event_id", "t")


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Events by six-hour windows whose cores are the middle two thirds."""
    hour = F.floor(F.col("us") / 3_600_000_000)
    s = series(spark, d).withColumns({"w": F.floor(hour / 6).cast("long"), "off": (hour % 6).cast("long")})
    return s.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off").between(1, 4)).alias("core"))


def proportional_times(spark: SparkSession, d: str) -> DataFrame:
    """A conversation of 600 seconds split over its turns by their words."""
    o = T.offsets(table(spark, d, "conversations"), "conv_id", "turn", F.size(X.words(F.col("text"))))
    total = F.max("w_end").over(Window.partitionBy("conv_id"))
    return o.select("conv_id", "turn", F.round(600 * F.col("w_start") / total, 2).alias("start_s"), F.round(600 * F.col("w_end") / total, 2).alias("end_s"))


def first_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first source that has a time: the value unless k is divisible by 3, else k, else nothing for k over 90."""
    s = series(spark, d)
    return s.select("user_id", "event_id", F.coalesce("v", F.when(F.col("k") <= 90, F.col("k").cast("double"))).alias("t"), F.when(F.col("v").isNotNull(), "first").when(F.col("k") <= 90, "second").otherwise("none").alias("source"))


QUERIES = {f.__name__: f for f in (clamped_times, interpolated, missing_runs, settled, segment_offsets, block_ends, overlapping_blocks, nearest_event, closest_view, largest_gap, remapped, shifted, bucketed, proportional_times, first_of_sources)}

_E = "s AS (SELECT *, epoch_us(ts) AS us, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT % 3 <> 0 THEN value END AS v FROM events)"
_C = r"c AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS n FROM conversations), o AS (SELECT conv_id, turn, (sum(n) OVER p - n)::BIGINT AS w_start, (sum(n) OVER p)::BIGINT AS w_end FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"
SQL = {
    "clamped_times": f"WITH {_E} SELECT user_id, event_id, max(v) OVER (o ROWS UNBOUNDED PRECEDING) AS t, coalesce(v <= lag(v) OVER o, false) AS back FROM s WINDOW o AS (PARTITION BY user_id ORDER BY event_id)",
    "interpolated": f"""WITH {_E}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM s),
a AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, last_value(v IGNORE NULLS) OVER b AS av, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS bi, first_value(v IGNORE NULLS) OVER f AS bv FROM i
  WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN av IS NOT NULL AND bv IS NOT NULL THEN av + (bv - av) * ((i - ai)::DOUBLE / (bi - ai)) ELSE coalesce(av, bv) END, 6) AS t FROM a""",
    "missing_runs": f"WITH {_E}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM s), m AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i WHERE v IS NULL) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*)::BIGINT AS n FROM m GROUP BY user_id, g HAVING count(*) >= 3",
    "settled": f"WITH {_E}, h AS (SELECT *, round(us / 3.6e9, 3) AS h, event_type = 'purchase' AS e FROM s), n AS (SELECT *, lag(h) OVER o AS a, lead(h) OVER o AS b, lag(e) OVER o AS ae FROM h WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CASE WHEN h - a > 0.5 AND b - h > 0.5 AND ae THEN round(b - 0.45, 3) WHEN h - a > 0.5 AND b - h > 0.5 AND e THEN round(a + 0.45, 3) ELSE h END AS t FROM n",
    "closest_view": f"WITH {_E}, p AS (SELECT user_id, us, event_id FROM s WHERE event_type = 'purchase'), v AS (SELECT user_id, us, event_id AS v FROM s WHERE event_type = 'view'), j AS (SELECT p.user_id, p.event_id, v, row_number() OVER (PARTITION BY p.user_id, p.event_id ORDER BY abs(p.us - v.us), v.us) AS r FROM p LEFT JOIN v USING (user_id)) SELECT user_id, event_id, v AS view_id FROM j WHERE r = 1",
    "segment_offsets": f"WITH {_C} SELECT * FROM o",
    "block_ends": f"WITH {_E} SELECT user_id, event_id, coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 999.0) AS end_s FROM s",
    "overlapping_blocks": f"WITH {_E}, e AS (SELECT *, us + floor(value * 900)::BIGINT * 1000000 AS e FROM s), g AS (SELECT *, CASE WHEN us < lag(e) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM e), h AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM g) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*)::BIGINT AS n FROM h GROUP BY user_id, g HAVING count(*) > 1",
    "nearest_event": f"WITH {_E}, p AS (SELECT user_id, us, event_id FROM s WHERE event_type = 'purchase'), v AS (SELECT user_id, us, event_id AS view_id FROM s WHERE event_type = 'view') SELECT p.user_id, event_id, view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.us",
    "largest_gap": f"WITH {_E}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)::DOUBLE / count(*) OVER (PARTITION BY user_id) AS p, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM s) SELECT user_id, arg_max(us, (gap, -event_id)) AS at, max(gap) AS gap FROM g WHERE p BETWEEN 0.2 AND 0.85 AND gap IS NOT NULL GROUP BY user_id",
    "remapped": f"WITH {_E}, x AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS n FROM s) SELECT user_id, event_id, (us + n * 10000000)::BIGINT AS moved FROM x WHERE event_type <> 'signup'",
    "shifted": "SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN floor(greatest(0.0, round(value - 1, 2))) ELSE greatest(0.0, round(value - 1, 2)) END::DOUBLE AS t FROM events",
    "bucketed": f"WITH {_E}, h AS (SELECT us // 3600000000 AS h FROM s) SELECT (h // 6)::BIGINT AS w, count(*)::BIGINT AS n, count(*) FILTER (WHERE h % 6 BETWEEN 1 AND 4)::BIGINT AS core FROM h GROUP BY 1",
    "proportional_times": f"WITH {_C} SELECT conv_id, turn, round(600 * w_start::DOUBLE / max(w_end) OVER (PARTITION BY conv_id), 2) AS start_s, round(600 * w_end::DOUBLE / max(w_end) OVER (PARTITION BY conv_id), 2) AS end_s FROM o",
    "first_of_sources": f"WITH {_E} SELECT user_id, event_id, coalesce(v, CASE WHEN k <= 90 THEN k::DOUBLE END) AS t, CASE WHEN v IS NOT NULL THEN 'first' WHEN k <= 90 THEN 'second' ELSE 'none' END AS source FROM s",
}
