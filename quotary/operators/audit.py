"""Audits of assembled results: coverage, pairing, repeats, labels, swaps, the publish gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotary.functions import text as X


def multiset_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """Rows missing from got and rows unexpected in it, by number."""
    return want.exceptAll(got).withColumn("side", F.lit("missing")).unionByName(got.exceptAll(want).withColumn("side", F.lit("unexpected")))


def word_coverage(source: DataFrame, shown: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lost, doubled): X24's totals. Words counted by their number of occurrences in the source and in what is shown."""
    each = lambda df, n: df.select(key, F.explode(F.transform(X.words(F.col(text)), X.latin_key)).alias("w")).withColumn("n", F.lit(n).cast("long"))
    left = each(source, 1).unionByName(each(shown, -1)).groupBy(key, "w").agg(F.sum("n").alias("n"))
    return left.groupBy(key).agg(F.sum(F.greatest(F.col("n"), F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("doubled"))


def pairing_outliers(rows: DataFrame, key: str, order: str, ours: Column, theirs: Column, factor: float = 2.2, words: int = 8) -> DataFrame:
    """(key, order, ratio, outlier): A14. Length ratios against the upper median of their document."""
    r = rows.select(key, order, ours.cast("double").alias("a"), theirs.cast("double").alias("b")).where("a > 0 and b > 0").withColumn("ratio", F.col("b") / F.col("a"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.row_number().over(Window.partitionBy(key).orderBy("ratio", order))
    mid = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col("ratio"))).over(Window.partitionBy(key))
    m = r.withColumns({"_n": n, "_i": i}).withColumn("_m", mid)
    expected = F.col("a") * F.col("_m")
    out = ((F.col("b") > factor * expected) | (F.col("b") * factor < expected)) & (F.abs(F.col("b") - expected) > words)
    return m.select(key, order, F.round("ratio", 6).alias("ratio"), out.alias("outlier"))


def missing_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, missing): A15. Numbers from the first to the last of a key that have no row."""
    span = rows.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    every = span.select(key, F.explode(F.sequence("lo", "hi")).alias("missing"))
    return every.join(rows.select(key, F.col(number).alias("missing")), [key, "missing"], "left_anti")


def quote_swap(text: Column, ours: Column, published: Column) -> Column:
    """Ours, if it stands exactly once in text, replaced by the published wording; its final stop stays."""
    stop = F.when(ours.rlike(r"[.!?]$") & ~published.rlike(r"[.!?]$"), F.right(ours, F.lit(1))).otherwise("")
    return F.when(X.count_of(text, ours) == 1, F.replace(text, ours, F.concat(published, stop))).otherwise(text)


def swap_verdict(ours: Column, published: Column) -> Column:
    """Why a swap isn't made, or ok: lengths apart, a first person that ours lacks, numbers that are dropped."""
    a, b = F.size(X.words(ours)), F.size(X.words(published))
    person = lambda t: F.size(F.array_intersect(F.transform(X.words(t), X.latin_key), F.array(*map(F.lit, ("i", "me", "my", "mine")))))
    digits = lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))
    return F.when((b < 0.5 * a) | (b > 1.8 * a), "length").when((person(published) > 0) & (person(ours) == 0), "person").when(F.size(F.array_except(digits(ours), digits(published))) > 0, "dropped").otherwise("ok")


def judged_swap(text: Column, ours: Column, published: Column) -> Column:
    """Why ours isn't replaced by the published wording in a text, or ok, by the first that holds: ours doesn't stand there exactly once; both are the same; their lengths are apart; the
    published one drops numbers or names, takes on a first person that ours has in the plural, or names whom the text doesn't."""
    from quotary.functions.cards import added_names, dropped_words, person_shift

    a, b = F.size(X.words(ours)), F.size(X.words(published))
    reasons = [("not once", X.count_of(text, ours) != 1), ("same", ours == published), ("length", (b < 0.5 * a) | (b > 1.8 * a)), ("drops", F.size(dropped_words(ours, published)) > 0), ("person", F.size(person_shift(ours, published)) > 0), ("adds", F.size(added_names(published, ours)) > 0)]
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(True)), why) for why, holds in reasons], F.lit("ok"))


def transcript_problem(text: Column, second: Column, letters: str = "A-Za-z", share: float = 0.95, least: float = 0.8) -> Column:
    """Why a text is no transcript, or null: under `share` of its letters are of the script (`letters`, as a set's content), or it has under `least` of the words of a
    second reading of the same, where there is one. A text without letters has none of the script."""
    every = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    own = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{letters}]")) / F.greatest(every, F.lit(1))
    n, m = F.size(X.words(text)), F.size(X.words(second))
    return F.when(own < share, F.concat(F.floor(own * 100 + 0.5).cast("string"), F.lit("% of its letters"))).when((m > 0) & (n < least * m), F.concat_ws(" ", n.cast("string"), F.lit("words against"), m.cast("string")))


def words_missing(a: Column, b: Column, edits: int = 1) -> Column:
    """Distinct plain Latin words of a, of four letters or more, that b lacks, one edit forgiven."""
    wa, wb = (F.array_distinct(F.filter(F.transform(X.words(t), X.latin_key), lambda w: w.rlike("^[a-z0-9]{4,}$"))) for t in (a, b))
    return F.filter(F.array_except(wa, wb), lambda w: ~F.exists(wb, lambda v: F.levenshtein(w, v, edits) >= 0))


def publish_gate(checks: list[DataFrame]) -> DataFrame:
    """(doc_id, fails, warnings, passed) over all checks' (doc_id, check, level)."""
    every = reduce(lambda x, y: x.unionByName(y), checks)
    g = every.groupBy("doc_id").agg(F.count_if(F.col("level") == "fail").alias("fails"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return g.withColumn("passed", F.col("fails") == 0)
