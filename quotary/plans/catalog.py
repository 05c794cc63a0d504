"""Queries of the catalogue operators: customers are entries, their nation a place, orders are published versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.functions import text as X
from quotary.operators import catalog as C
from quotary.sources.tables import table


def entries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey")).alias("slug"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("note"), F.array().cast("array<string>").alias("old_slugs"), F.col("c_nationkey").alias("place"))


def upsert_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every third entry is published again, some under a new slug and with no note; new ones come in."""
    e = entries(spark, d)
    new = e.where("id % 3 = 0").select((F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000)).alias("id"), F.when(F.col("id") % 4 == 0, F.concat("slug", F.lit("b"))).otherwise(F.col("slug")).alias("slug"), F.upper("title").alias("title"), F.when(F.col("id") % 5 == 0, F.lit("new")).alias("note"), "old_slugs", "place")
    return C.upsert(e, new, "id", ["note"], "slug").withColumn("old_slugs", F.array_join("old_slugs", ","))


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer and month of their date."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("day"))
    return C.assign_ids(o, "o_custkey", "day", "o_orderkey").select("o_orderkey", "id")


def resolved_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Asked slugs, by present or former name."""
    e = entries(spark, d).withColumn("old_slugs", F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("old"), F.col("id").cast("string")))).otherwise(F.col("old_slugs")))
    asked = table(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "old").otherwise("s"), F.col("o_custkey").cast("string")).alias("asked"))
    return C.resolve_alias(asked, e, "asked", "id", "slug", "old_slugs").select("o_orderkey", "entry", "redirect")


def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest orders, by day and then by key."""
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).orderBy(F.desc("day"), "o_orderkey").limit(200)


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return C.keep_latest(o, "o_custkey", [F.col("day").desc(), F.col("o_orderkey").desc()])


def featured(spark: SparkSession, d: str) -> DataFrame:
    """One featured entry a place."""
    e = entries(spark, d).select("place", "id", (F.col("id") % 7 == 0).alias("featured"))
    return C.one_featured(e, "featured", [F.col("id")], ["place"])


def first_claims(spark: SparkSession, d: str) -> DataFrame:
    """The first supplier to ship an order has it."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_linenumber")
    return C.claim_once(li, "l_orderkey", "day", "l_linenumber", "l_suppkey").select("l_orderkey", "l_suppkey", "day")


def due_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs."""
    j = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("next"), (F.col("o_custkey") % 30).cast("long").alias("tries"))
    return C.due(j, F.to_timestamp(F.lit("1995-06-17 00:00:00"))).select("o_orderkey", "tries", F.date_format("next", "yyyy-MM-dd HH:mm").alias("next"))


def matched_places(spark: SparkSession, d: str) -> DataFrame:
    """Places by name in any case, or by their second name."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("second"))
    asked = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nm"), F.col("second").alias("sc")), "k").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("nm")).otherwise(F.col("sc")).alias("asked"))
    names = n.select(F.lower("n_name").alias("asked"), "n_nationkey").unionByName(n.select(F.col("second").alias("asked"), "n_nationkey"))
    return asked.join(names, "asked", "left").select("s_suppkey", F.col("n_nationkey").alias("place"))


def valid_entries(spark: SparkSession, d: str) -> DataFrame:
    """Customers by whether their name has the asked form."""
    ok = F.col("c_name").rlike(r"^Customer#[0-9]+$")
    return table(spark, d, "customer").groupBy(ok.alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def seeded(spark: SparkSession, d: str) -> DataFrame:
    """Nations as target, regions as seed: the seed isn't loaded."""
    from quotary.sources.tables import when_empty

    return when_empty(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


def visible_comments(spark: SparkSession, d: str) -> DataFrame:
    """Turns as feedback; those that a system turn of their conversation hides by number are out."""
    c = table(spark, d, "conversations")
    hidden = c.where("role = 'system'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    return c.join(hidden, ["conv_id", "turn"], "left_anti").where("role <> 'system'").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def stored_columns(spark: SparkSession, d: str) -> DataFrame:
    """The page's projection: only set fields, defaults, lengths cut."""
    return entries(spark, d).select("id", F.coalesce("note", F.lit("")).alias("note"), F.left("title", F.lit(12)).alias("title"), X.hash_id(F.col("slug")).alias("hash"), F.left(F.sha1("slug"), F.lit(16)).alias("hash1"))


def join_titles(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the title of their customer, where there is one."""
    e = entries(spark, d).where("id % 5 <> 0").select(F.col("id").alias("o_custkey"), "title")
    return table(spark, d, "orders").join(e, "o_custkey", "left").groupBy(F.coalesce("title", F.lit("?")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def running_cost(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in turn, as long as their running cost is within the cap."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("cost"))
    return o.withColumn("upto", F.sum("cost").over(w)).where("upto <= 500000").select("o_custkey", "o_orderkey", "upto")


QUERIES = {f.__name__: f for f in (upsert_entries, assigned_ids, resolved_aliases, newest_first, latest_versions, featured, first_claims, due_jobs, matched_places, valid_entries, seeded, visible_comments, stored_columns, join_titles, running_cost)}

_E = "e AS (SELECT c_custkey AS id, 's' || c_custkey AS slug, c_name AS title, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS note, c_nationkey AS place FROM customer)"
SQL = {
    "upsert_entries": f"""WITH {_E}, n AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 10000000 END AS id, CASE WHEN id % 4 = 0 THEN slug || 'b' ELSE slug END AS slug, upper(title) AS title, CASE WHEN id % 5 = 0 THEN 'new' END AS note, place FROM e WHERE id % 3 = 0)
SELECT coalesce(n.id, e.id) AS id, coalesce(n.slug, e.slug) AS slug, coalesce(n.title, e.title) AS title, coalesce(n.note, e.note) AS note, CASE WHEN n.slug <> e.slug THEN e.slug ELSE '' END AS old_slugs, coalesce(n.place, e.place) AS place FROM e FULL JOIN n ON e.id = n.id""",
    "assigned_ids": "WITH o AS (SELECT o_orderkey, o_custkey || strftime(date_trunc('month', o_orderdate), '%y%m%d') AS b, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS id FROM o",
    "resolved_aliases": f"""WITH {_E}, a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 's' END || o_custkey AS asked FROM orders)
SELECT o_orderkey, coalesce(e.id, f.id) AS entry, CASE WHEN e.id IS NOT NULL THEN false WHEN f.id IS NOT NULL THEN true END AS redirect FROM a LEFT JOIN e ON asked = e.slug LEFT JOIN e f ON asked = 'old' || f.id AND f.id % 3 = 0""",
    "newest_first": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY day DESC, o_orderkey LIMIT 200",
    "latest_versions": "SELECT o_custkey, o_orderkey, day FROM (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "featured": f"WITH {_E} SELECT place, id, row_number() OVER (PARTITION BY place ORDER BY (id % 7 = 0)::INT DESC, id) = 1 AS featured FROM e",
    "first_claims": "SELECT l_orderkey, l_suppkey, day FROM (SELECT l_orderkey, l_suppkey, l_shipdate::DATE AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate::DATE, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1",
    "due_jobs": "SELECT o_orderkey, (o_custkey % 30 + 1)::BIGINT AS tries, '1995-06-17 01:00' AS next FROM orders WHERE o_orderdate::TIMESTAMP <= TIMESTAMP '1995-06-17' AND o_custkey % 30 < 24",
    "matched_places": "SELECT s_suppkey, s_nationkey AS place FROM supplier",
    "valid_entries": "SELECT regexp_matches(c_name, '^Customer#[0-9]+$') AS valid, count(*)::BIGINT AS n FROM customer GROUP BY 1",
    "seeded": "SELECT n_name AS name FROM nation",
    "visible_comments": "SELECT role, count(*)::BIGINT AS n FROM conversations c WHERE role <> 'system' AND NOT EXISTS (SELECT 1 FROM conversations h WHERE h.role = 'system' AND h.conv_id = c.conv_id AND h.turn + 1 = c.turn) GROUP BY role",
    "stored_columns": f"WITH {_E} SELECT id, coalesce(note, '') AS note, title[1:12] AS title, sha256(slug)[1:16] AS hash, sha1(slug)[1:16] AS hash1 FROM e",
    "join_titles": f"WITH {_E} SELECT coalesce(title, '?') AS title, count(*)::BIGINT AS n FROM orders LEFT JOIN e ON o_custkey = id AND id % 5 <> 0 GROUP BY 1",
    "running_cost": "SELECT o_custkey, o_orderkey, upto::BIGINT AS upto FROM (SELECT o_custkey, o_orderkey, sum(round(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM orders) WHERE upto <= 500000",
}
