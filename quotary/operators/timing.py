"""Word times: offsets, clamps, interpolation, repairs, as-of joins and remaps of an ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_increasing(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """The running maximum; nulls take what was reached so far."""
    return df.withColumn(out, F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Nulls between two anchors lie on the line between them, by rank; at the ends the nearest anchor holds."""
    w = Window.partitionBy(key).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_a", F.last(at, ignorenulls=True).over(back)).withColumn("_b", F.first(at, ignorenulls=True).over(ahead))
    step = (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * step
    return df.withColumn(out, F.coalesce(F.col(value), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line), F.col("_a.v"), F.col("_b.v"))).drop("_i", "_a", "_b")


def missing_runs(df: DataFrame, key: str, order: str, value: str, least: int) -> DataFrame:
    """(key, first, last, n): W12. Runs of `least` nulls or more."""
    w = Window.partitionBy(key).orderBy(order)
    i = df.withColumn("_i", F.row_number().over(w)).where(F.col(value).isNull())
    isle = i.withColumn("_isle", F.col("_i") - F.row_number().over(w))
    return isle.groupBy(key, "_isle").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_isle")


def settle_lone(df: DataFrame, key: str, order: str, value: str, far: float, ends: Column, out: str, step: float = 0.45) -> DataFrame:
    """A value over `far` above its neighbour before and below the one after goes next to the one whose sentence it belongs
    to, `step` from it: to the one after if the row before ends a sentence, to the one before if its own row does. One
    pass over the given values; other lone values stay."""
    w = Window.partitionBy(key).orderBy(order)
    df = df.withColumn("_e", ends)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    lone = (F.col(value) - a > far) & (b - F.col(value) > far)
    moved = F.when(F.lag("_e").over(w), b - step).when(F.col("_e"), a + step).otherwise(F.col(value))
    return df.withColumn(out, F.when(lone, F.round(moved, 3)).otherwise(F.col(value))).drop("_e")


def offsets(df: DataFrame, key: str, order: str, size: Column, start: str = "w_start", end: str = "w_end") -> DataFrame:
    """Cumulative positions of segments by their sizes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", size.cast("long")).withColumn(end, F.sum("_n").over(w).cast("long"))
    return df.withColumn(start, F.col(end) - F.col("_n")).drop("_n")


def with_end(df: DataFrame, key: str, order: str, start: str, total: Column, out: str = "end_s") -> DataFrame:
    """A block ends where the next one that has a start begins, the last at `total`."""
    after = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.first(start, ignorenulls=True).over(after), total))


def overlapping(df: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """(key, first, last, n): groups of consecutive blocks that begin before the block before has ended."""
    w = Window.partitionBy(key).orderBy(order)
    on = F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False))
    g = df.withColumn("_g", F.when(on, 0).otherwise(1))
    g = g.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("_g")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, order: str, carry: list[str]) -> DataFrame:
    """Left rows with the latest right row at or before them: both sides in one sorted series, no pairs."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(key, at, *[F.col(c).alias(f"_r_{c}") for c in carry]).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", *([order] if order in left.columns else [])).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_h", F.last(F.when(F.col("_side") == 0, F.struct(*[F.col(f"_r_{c}").alias(c) for c in carry])), ignorenulls=True).over(w))
    return held.where("_side = 1").select(*left.columns, *[F.col(f"_h.{c}").alias(f"prev_{c}") for c in carry])


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, carry: str, out: str) -> DataFrame:
    """Left rows with the right row nearest to them by absolute distance, the earlier of equals: both sides in one sorted
    series, in which each left row sees the last right row up to it and the first from it on."""
    held = F.struct(F.col(at).alias("at"), F.col(carry).alias("c"))
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, at, held.alias("_h")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side")
    back = F.last("_h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_h", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    r = both.withColumns({"_b": back, "_a": ahead}).where("_side = 1")
    later = F.coalesce(F.col("_a.at") - F.col(at) < F.col(at) - F.col("_b.at"), F.col("_b").isNull())
    return r.withColumn(out, F.when(later, F.col("_a.c")).otherwise(F.col("_b.c"))).drop("_side", "_h", "_b", "_a")


def largest_gap(df: DataFrame, key: str, order: str, value: str, lo: float = 0.2, hi: float = 0.85) -> DataFrame:
    """(key, at, gap): A21. The largest step to the next row among rows whose share of the series lies in [lo, hi]."""
    w = Window.partitionBy(key).orderBy(value, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    g = df.withColumn("_p", F.row_number().over(w) / n).withColumn("_gap", F.lead(value).over(w) - F.col(value))
    inside = g.where((F.col("_p") >= lo) & (F.col("_p") <= hi) & F.col("_gap").isNotNull())
    return inside.groupBy(key).agg(F.max(F.struct("_gap", (-F.col(order)).alias("o"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias("at"), F.col("m._gap").alias("gap"))


def remap_timeline(words: DataFrame, inserts: DataFrame, key: str, at: str, length: str, out: str) -> DataFrame:
    """Times moved on by all that was inserted before them, in one sorted series of words and inserts."""
    both = words.withColumn("_ins", F.lit(0.0)).unionByName(inserts.select(key, at, F.col(length).alias("_ins")), allowMissingColumns=True).withColumn("_side", F.when(F.col("_ins") > 0, 0).otherwise(1))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.col(at) + F.sum("_ins").over(w)).where("_side = 1").drop("_ins", "_side")


def overlapping_windows(series: DataFrame, key: str, total: str, length: float, overlap: float) -> DataFrame:
    """(key, window, start, lo, hi): X35. Windows of `length` that begin a length less the overlap apart, as long as one begins before the
    last overlap of a series' total; cores [lo, hi) meet in the middle of the overlaps, the first and the last are open at their ends."""
    step = length - overlap
    last = F.greatest(F.ceil((F.col(total) - overlap) / step) - 1, F.lit(0)).cast("int")
    w = series.select(key, last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("window")).withColumn("start", F.col("window") * F.lit(float(step)))
    lo = F.when(F.col("window") == 0, float("-inf")).otherwise(F.col("start") + overlap / 2)
    hi = F.when(F.col("window") == F.col("_last"), float("inf")).otherwise(F.col("start") + step + overlap / 2)
    return w.select(key, "window", "start", lo.alias("lo"), hi.alias("hi"))


def stitched(heard: DataFrame, windows: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Rows that were timed within their `window` with times of the whole series, those alone that lie in their window's core: a row
    that two windows time alike counts in one."""
    moved = heard.join(windows.select(key, "window", "start", "lo", "hi"), [key, "window"]).withColumn(at, F.col(at) + F.col("start"))
    return moved.where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("start", "lo", "hi")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points with each range [lo, hi) of their key that holds them. Ranges stand in all buckets of `width` that they touch and points in
    one, so both meet by an equi-join whatever the ranges' overlaps; choose a width near the usual range's. An open end
    reaches no further than the points of its key do."""
    bucket = lambda x: F.floor(x / width).cast("long")
    ends = points.groupBy(key).agg(F.min(at).alias("_min"), F.max(at).alias("_max"))
    touched = F.sequence(bucket(F.greatest(F.col(lo), F.col("_min"))), bucket(F.least(F.col(hi), F.col("_max"))))
    spread = ranges.join(ends, key).where((F.col(lo) <= F.col("_max")) & (F.col(hi) > F.col("_min")) & (F.col(lo) < F.col(hi))).withColumn("_b", F.explode(touched)).drop("_min", "_max")
    return points.withColumn("_b", bucket(F.col(at))).join(spread, [key, "_b"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_b")


def first_ending_after(rows: DataFrame, segments: DataFrame, key: str, at: str, end: str, carry: str, out: str) -> DataFrame:
    """Rows with the first segment of their key that ends after them, the smaller `carry` of equal ends; past the last end null. Both
    sides stand in one sorted series, in which each row sees the next end."""
    held = F.struct(F.col(end).alias("at"), F.col(carry).alias("c"))
    both = rows.withColumn("_side", F.lit(1)).unionByName(segments.groupBy(key, end).agg(F.min(carry).alias(carry)).select(key, F.col(end).alias(at), held.alias("_h")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(0, Window.unboundedFollowing)  # an end at a row's own time stands before it
    return both.withColumn(out, F.first("_h", ignorenulls=True).over(w)["c"]).where("_side = 1").drop("_side", "_h")
