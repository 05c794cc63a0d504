"""The catalogue of entries: upsert, ids, aliases, listings, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, keep: list[str], slug: str | None = None, history: str = "old_slugs") -> DataFrame:
    """Target with source's rows inserted or put over it by key. Columns of `keep` hold their old value where the new
    one is null; all others take the new one. A slug that changes is added to the history, an array, without itself. One
    full outer join on the key; no table format is assumed."""
    cols = [c for c in target.columns if c != key]
    s = source.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_s_{c}") for c in cols if c in source.columns])
    j = target.withColumn("_old", F.lit(True)).join(s, F.col(key) == F.col("_k"), "full_outer")
    out = [F.coalesce("_k", key).alias(key)]
    for c in cols:
        new = F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        if c == history and slug:
            moved = F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col(f"_s_{slug}") != F.col(slug))
            before = F.coalesce(F.col(c), F.array().cast("array<string>"))
            out.append(F.when(moved, F.array_remove(F.array_distinct(F.concat(before, F.array(slug))), F.col(f"_s_{slug}"))).otherwise(before).alias(c))
        elif c in keep:
            out.append(F.coalesce(new, F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_new").isNotNull(), new).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def one_featured(entries: DataFrame, flag: str, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Of each group the first flagged row keeps its flag; without one the first row has it."""
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.col(flag).cast("int").desc(), *order)
    return entries.withColumn(flag, F.row_number().over(w) == 1)


def assign_ids(entries: DataFrame, place: str, day: str, order: str, out: str = "id") -> DataFrame:
    """Place and day, with -2, -3 for later entries of one day."""
    n = F.row_number().over(Window.partitionBy(place, day).orderBy(order))
    base = F.concat(F.col(place).cast("string"), F.date_format(day, "yyMMdd"))
    return entries.withColumn(out, F.when(n == 1, base).otherwise(F.concat_ws("-", base, n)))


def resolve_alias(requests: DataFrame, entries: DataFrame, asked: str, key: str, slug: str, history: str) -> DataFrame:
    """Requests with the key of the entry whose present or former slug they name; present ones win."""
    now = entries.select(F.col(slug).alias("_a"), F.col(key).alias("_k"), F.lit(0).alias("_r"))
    old = entries.select(F.explode(history).alias("_a"), F.col(key).alias("_k"), F.lit(1).alias("_r"))
    best = now.unionByName(old).groupBy("_a").agg(F.min(F.struct("_r", "_k")).alias("_m"))
    return requests.join(best, F.col(asked) == F.col("_a"), "left").select(*requests.columns, F.col("_m._k").alias("entry"), (F.col("_m._r") == 1).alias("redirect"))


def keep_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def claim_once(claims: DataFrame, job: str, *order: str) -> DataFrame:
    """The first claim of each job, in the given order."""
    return keep_latest(claims, job, [F.col(c).asc() for c in order])


def due(jobs: DataFrame, now: Column, most: int = 24) -> DataFrame:
    """Jobs whose next try is due and that have tries left, with their next try an hour on."""
    return jobs.where((F.col("next") <= now) & (F.col("tries") < most)).withColumns({"tries": F.col("tries") + 1, "next": now + F.expr("interval 1 hour")})
