"""Token and n-gram tables, and the n-gram join of documents with a canon of passages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotary.functions.text import latin_key, let, words


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, raw, word): words by position from 0. A word's key may be empty; its position stays."""
    return df.select(key, F.posexplode(words(F.col(text))).alias("pos", "raw")).select(key, F.col("pos").cast("long").alias("pos"), "raw", latin_key(F.col("raw")).alias("word"))


def grams(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, pos, gram) of word keys, from the row's own array: no shuffle. Rows of fewer than n words have none."""
    keyed = df.select(key, F.transform(words(F.col(text)), latin_key).alias("w")).where(F.size("w") >= n)
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return keyed.select(key, F.posexplode(each).alias("pos", "gram")).withColumn("pos", F.col("pos").cast("long"))


def gram_hashes(keys: Column, n: int) -> Column:
    """array<struct<h, c>>: for each place in an array of keys a 64-bit and a 32-bit hash of the n keys that begin there, 96
    bits that stand for the n-gram. Each key is hashed once."""
    some = lambda f, a, i: f(*[F.get(a, i + k) for k in range(n)])
    starts = lambda a: F.when(F.size(a) >= n, F.sequence(F.lit(0), F.size(a) - n)).otherwise(F.array().cast("array<int>"))
    return let(F.transform(keys, lambda w: F.xxhash64(w)), lambda a: F.transform(starts(a), lambda i: F.struct(some(F.xxhash64, a, i).alias("h"), some(F.hash, a, i).alias("c"))))


def hashed_grams(df: DataFrame, keys: list[str], text: str, n: int = 4, key: Callable[[Column], Column] = latin_key) -> DataFrame:
    """(keys, pos, h, c): the n-grams of a text as hashes, by position."""
    # an array in a node of its own, so that the keys are made once a row
    rows = df.select(*keys, F.explode(F.array(F.transform(words(F.col(text)), key))).alias("_w")).where(F.size("_w") >= n)
    return rows.select(*keys, F.posexplode(gram_hashes(F.col("_w"), n)).alias("pos", "g")).select(*keys, F.col("pos").cast("long").alias("pos"), "g.h", "g.c")


def gram_join(docs: DataFrame, canon: DataFrame, doc: str, passage: list[str], most_passages: int = 150) -> DataFrame:
    """(doc, passage, p, q): document position p and passage position q of each shared gram (J1, J2), of hashed grams.

    Grams in more than `most_passages` passages are left out: they tell nothing and would be the join's hot keys. Which
    side is broadcast is left to the sizes that Spark finds; rows are two hashes and two numbers.
    """
    common = canon.groupBy("h", "c").agg(F.count_distinct(F.struct(*passage)).alias("df")).where(F.col("df") <= most_passages).select("h", "c")
    held = canon.join(common, ["h", "c"], "left_semi").select("h", "c", *passage, F.col("pos").alias("q"))
    return docs.select(doc, "h", "c", F.col("pos").alias("p")).join(held, ["h", "c"]).select(doc, *passage, "p", "q")


def unique_anchors(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, anchors, on_main): W13. rows(doc, a, b): hashes of a document's n-grams by position and those of its other reading. How
    many n-grams stand once in either, and how many of them have the most frequent shift. A row's own arrays: no shuffle."""

    def once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, at, n = np.unique(x, return_index=True, return_counts=True)
        return v[n == 1], at[n == 1]

    def run(batches):
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                (va, pa_), (vb, pb) = (once(np.asarray(batch.column(c)[i].values if batch.column(c)[i].is_valid else [], np.int64)) for c in ("a", "b"))
                _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
                if len(ia):
                    got.append((i, len(ia), int(np.unique(pa_[ia] - pb[ib], return_counts=True)[1].max())))
            kept = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(kept), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2))], names=[doc, "anchors", "on_main"])

    return rows.mapInArrow(run, f"{doc} {rows.schema[doc].dataType.simpleString()}, anchors long, on_main long")
