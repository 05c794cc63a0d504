"""Span algebra: chaining hits, merging, runs, extension and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_hits(hits: DataFrame, keys: list[str], n: int = 4, max_step: int = 6, max_shift: int = 2, min_words: int = 8) -> DataFrame:
    """(keys, w_start, w_end, matched, hits): W1. Hits of one document and passage, in document order, are one run while the next is
    at most max_step words on, its diagonal shifts by at most max_shift and the passage doesn't run backwards. matched
    counts the words that hits cover; runs with fewer than min_words are dropped. The window holds one document's hits
    of one passage."""
    order = Window.partitionBy(*keys).orderBy("p", "q")
    lp, lq = F.lag("p").over(order), F.lag("q").over(order)
    broken = lp.isNull() | (F.col("p") - lp > max_step) | (F.abs((F.col("p") - F.col("q")) - (lp - lq)) > max_shift) | (F.col("q") < lq)
    runs = hits.withColumn("_new", F.when(broken, 1).otherwise(0)).withColumn("_own", F.when(broken, n).otherwise(F.least(F.lit(n), F.col("p") - lp)))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "_run").agg(F.min("p").alias("w_start"), (F.max("p") + n).alias("w_end"), F.sum("_own").cast("long").alias("matched"), F.count(F.lit(1)).alias("hits"))
    return spans.where(F.col("matched") >= min_words).drop("_run")


def merge_spans(spans: DataFrame, keys: list[str], start: str = "w_start", end: str = "w_end", gap: int = 0, carry: str | None = None) -> DataFrame:
    """(keys, start, end, parts[, ids]): W2, W3. Spans that overlap or touch are one, and so are those at most `gap` apart that
    carry the same as the span before them; what they carry is collected."""
    order = Window.partitionBy(*keys).orderBy(start, end, *([carry] if carry else []))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    joins = F.col(start) <= reach
    if gap and carry:
        joins = joins | ((F.col(start) <= reach + gap) & (F.col(carry) == F.lag(carry).over(order)))
    isle = F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")]
    if carry:
        aggs.append(F.array_sort(F.collect_set(carry)).alias("ids"))
    return spans.withColumn("_isle", isle).groupBy(*keys, "_isle").agg(*aggs).drop("_isle")


def consecutive_runs(parts: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last, n): W18. Numbers that follow each other are one range."""
    order = Window.partitionBy(*keys).orderBy(number)
    return parts.select(*keys, number).distinct().withColumn("_isle", F.col(number) - F.row_number().over(order)).groupBy(*keys, "_isle").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_isle")


def longest_per(spans: DataFrame, keys: list[str], start: str = "w_start", end: str = "w_end") -> DataFrame:
    """Of each key the longest span, the first of equals."""
    order = Window.partitionBy(*keys).orderBy((F.col(end) - F.col(start)).desc(), start)
    return spans.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def select_non_overlapping(spans: DataFrame, keys: list[str], rank: list[Column], start: str = "w_start", end: str = "w_end") -> DataFrame:
    """(keys, start, end): W7. Of each key the spans in order of rank, each kept if it overlaps none kept before.

    A fold over the key's candidates, held in one row: candidates are to be cut by the gates before."""
    c = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(start).alias("s"), F.col(end).alias("e"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    taken = F.aggregate(
        "_c", none,
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["s"].cast("long").alias("s"), x["e"].cast("long").alias("e"))))),
    )
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("_c")).select(*keys, F.explode(taken).alias("_t")).select(*keys, F.col("_t.s").alias(start), F.col("_t.e").alias(end))


def diagonal_islands(hits: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """(keys, w_start, w_end, q_start): X3. Hits that follow each other on one diagonal are one exact stretch."""
    order = Window.partitionBy(*keys, "_d").orderBy("p")
    isle = hits.withColumn("_d", F.col("p") - F.col("q")).withColumn("_i", F.col("p") - F.row_number().over(order))
    return isle.groupBy(*keys, "_d", "_i").agg(F.min("p").alias("w_start"), (F.max("p") + n).alias("w_end"), F.min("q").alias("q_start")).drop("_d", "_i")


def uncovered(spans: DataFrame, lengths: DataFrame, key: str, start: str = "w_start", end: str = "w_end", n: str = "n_words") -> DataFrame:
    """(key, gap_start, gap_end): the stretches of a document that no span covers, from disjoint spans."""
    order = Window.partitionBy(key).orderBy(start)
    inner = spans.select(key, F.coalesce(F.lag(end).over(order), F.lit(0).cast("long")).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = lengths.join(spans.groupBy(key).agg(F.max(end).alias("_e")), key, "left").select(key, F.coalesce("_e", F.lit(0).cast("long")).alias("gap_start"), F.col(n).alias("gap_end"))
    return inner.unionByName(tail).where("gap_start < gap_end")
