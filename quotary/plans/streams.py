"""Queries of the streaming operators: the event table read as a stream to its end; results equal the batch forms'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.streaming import streams as S


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, f"{d}/events.parquet")


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """R11, R6."""
    return S.run_to_end(S.daily(_events(spark, d)), "complete")


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """R2, R3."""
    return S.run_to_end(S.totals(_events(spark, d), "user_id", "event_id"), "complete").select("event_type", "views")


def stream_live(spark: SparkSession, d: str) -> DataFrame:
    """Signups join, errors leave."""
    return S.run_to_end(S.live_counts(_events(spark, d), "user_id", "signup", "error"), "complete")


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """R8."""
    folded = S.fold(_events(spark, d).withColumn("day", F.to_date("ts")), ["user_id", "day"])
    return S.run_to_end(folded, "complete").select("user_id", "day", "most", "snapshots")


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """R7."""
    return S.run_to_end(S.first_seen(_events(spark, d), "user_id"), "complete").select("user_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


def stream_throttle(spark: SparkSession, d: str) -> DataFrame:
    """One event a user in six hours; purchases always pass."""
    return S.run_to_end(S.throttle(_events(spark, d), "user_id", 21600, "purchase"), "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("passed"))


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Five events a user in ten hours."""
    r = S.run_to_end(S.rate_limit(_events(spark, d), "user_id", 5, 36000), "append")
    return r.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def stream_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Addresses are users, looked up 40 times a day at most and known for three days; errors aren't found."""
    e = _events(spark, d).select("event_id", "ts", "user_id", (F.col("event_type") != "error").alias("found"))
    r = S.run_lookups(e, "user_id", "found", most=40, span=86_400, keep=259_200)
    return r.groupBy("user_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Props name the job."""
    return S.run_to_end(S.job_states(_events(spark, d), "props", "event_id"), "complete")


QUERIES = {f.__name__: f for f in (stream_daily, stream_totals, stream_live, stream_fold, stream_first_seen, stream_throttle, stream_rate_limit, stream_lookups, stream_jobs)}
SQL = {
    "stream_daily": "SELECT ts::DATE AS day, count(*)::BIGINT AS views FROM events GROUP BY 1",
    "stream_totals": "SELECT event_type, count(DISTINCT event_id)::BIGINT AS views FROM events GROUP BY 1",
    "stream_live": "SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END)::BIGINT AS live FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1",
    "stream_fold": "SELECT user_id, ts::DATE AS day, max(value) AS most, count(*)::BIGINT AS snapshots FROM events GROUP BY ALL",
    "stream_first_seen": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts FROM events GROUP BY 1",
    "stream_throttle": """WITH l AS (SELECT user_id, list({'t': epoch_us(ts), 'p': event_type = 'purchase'} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(l, lambda s, x: CASE WHEN x.p THEN {'last': s.last, 'n': s.n + 1} WHEN s.last IS NULL OR x.t - s.last >= 21600000000 THEN {'last': x.t, 'n': s.n + 1} ELSE s END, {'last': NULL::BIGINT, 'n': 0::BIGINT}) AS s FROM l)
SELECT user_id, s.n AS passed FROM f""",
    "stream_rate_limit": "WITH r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '35999.999999' SECOND PRECEDING AND CURRENT ROW) <= 5 AS ok FROM events) SELECT user_id, count(*) FILTER (WHERE ok)::BIGINT AS allowed, count(*) FILTER (WHERE NOT ok)::BIGINT AS refused FROM r GROUP BY user_id",
    "stream_lookups": """WITH e AS (SELECT list({'i': event_id, 'u': user_id, 't': epoch_us(ts), 'f': event_type <> 'error', 'd': 0::BIGINT, 'n': 0::BIGINT, 'k': MAP {}::MAP(BIGINT, BIGINT), 'v': []::VARCHAR[]} ORDER BY ts, event_id) AS e FROM events),
r AS (SELECT e, list_reduce(list_prepend({'i': 0::BIGINT, 'u': 0::BIGINT, 't': 0::BIGINT, 'f': false, 'd': -1::BIGINT, 'n': 0::BIGINT, 'k': MAP {}::MAP(BIGINT, BIGINT), 'v': []::VARCHAR[]}, e), lambda s, x:
  CASE WHEN coalesce(s.k[x.u], 0) > x.t THEN {'i': x.i, 'u': x.u, 't': x.t, 'f': x.f, 'd': s.d, 'n': s.n, 'k': s.k, 'v': list_append(s.v, 'known')}
    WHEN CASE WHEN s.d = x.t // 86400000000 THEN s.n ELSE 0 END < 40 THEN {'i': x.i, 'u': x.u, 't': x.t, 'f': x.f, 'd': x.t // 86400000000, 'n': CASE WHEN s.d = x.t // 86400000000 THEN s.n ELSE 0 END + 1, 'k': CASE WHEN x.f THEN map_concat(s.k, MAP {x.u: x.t + 259200000000}) ELSE s.k END, 'v': list_append(s.v, 'looked up')}
    ELSE {'i': x.i, 'u': x.u, 't': x.t, 'f': x.f, 'd': s.d, 'n': s.n, 'k': s.k, 'v': list_append(s.v, 'refused')} END).v AS v FROM e)
SELECT user_id, verdict, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(e, lambda x: x.u)) AS user_id, unnest(v) AS verdict FROM r) GROUP BY ALL""",
    "stream_jobs": "SELECT props, arg_min(user_id, event_id) AS claimed_by, arg_max(event_type, event_id) AS state, count(*)::BIGINT AS changes FROM events GROUP BY props",
}
