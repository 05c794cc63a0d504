"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's dimensions are its terms. A block of candidates is turned into postings, dimension by dimension; a block of
sparse queries scatters weight x posting into dense score arrays, a dimension at a time. Each pair of blocks keeps its
best by partition selection; the parts of a query are merged by a window over k rows a candidate block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table

#: Queries are the rows whose id is divisible by this.
EVERY = 50
TOP = 5
#: Candidates and queries of a tile, what one group holds, and queries that are scored at a time: a dense score array takes
#: 8 bytes for each of these and each candidate, 16 MB at most.
CANDIDATES, ASKED, QUERIES = 8192, 4096, 256
#: Weights beyond this are scored in whole numbers of any size, as a product might not fit 64 bits.
WIDE = 1 << 24


def quantize(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(key, weights): floor(scale * x) of each component, x as double. Vectors that are null, or hold a component that
    is null or not finite, take no part; so don't rows with a null key. A weight beyond 64 bits is an error."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: v * F.lit(float(scale)))
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias(key), F.transform(x, lambda v: F.floor(v).cast("long")).alias("weights"))


def _matrix(lists: list) -> np.ndarray:
    """Rows of weights, shorter ones filled with 0: a dimension that a vector lacks adds nothing."""
    width = max((len(x) for x in lists), default=0)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, a dimension at a time: the queries that have the term add its postings to their score arrays."""
    width = min(queries.shape[1], candidates.shape[1])
    wide = max((int(np.abs(x).max()) for x in (queries, candidates) if x.size), default=0) > WIDE
    kind = object if wide else np.int64
    total = np.zeros((len(queries), len(candidates)), kind)
    for d in range(width):
        rows = np.flatnonzero(candidates[:, d])  # the term's postings
        asks = np.flatnonzero(queries[:, d])
        if len(rows) and len(asks):
            weights, posted = queries[asks, d].astype(kind), candidates[rows, d].astype(kind)
            if len(rows) == len(candidates) and len(asks) == len(queries):
                total += np.multiply.outer(weights, posted)
            else:
                total[np.ix_(asks, rows)] += np.multiply.outer(weights, posted)
    return total


def best(total: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of the k best scores of each query, ties to smaller ids; a row isn't its own candidate."""
    rows, cols = [], []
    for i, score in enumerate(total):
        use = np.flatnonzero(ids != own[i])
        if len(use) > k:
            part = score[use]
            # all that reach the k-th best score, ties included, then their order
            edge = np.partition(part, len(part) - k)[len(part) - k] if part.dtype != object else np.sort(part)[len(part) - k]
            use = use[part >= edge]
        order = np.lexsort((ids[use], -score[use])) if total.dtype != object else np.array(sorted(range(len(use)), key=lambda x: (-score[use[x]], ids[use[x]])), int)
        use = use[order][:k]
        rows.append(np.full(len(use), i))
        cols.append(use)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k other rows of the highest
    integer inner product, ties to the smaller key; all, if there are fewer.

    Keys name rows: rows that repeat a key are candidates each, never of a query of their own key, and such a query is
    asked once, by one of its rows (the greatest weights in order of their components). A vector that lacks dimensions of a query has 0
    there. Null and non-finite vectors and null keys take no part. An empty table, or one without queries, gives an empty
    result. Other columns of vectors are not read. A score outside 64 bits is an error.
    """
    spark = vectors.sparkSession
    weights = materialize(quantize(vectors, key, vector).withColumnRenamed(key, "id"), "weights")
    n = weights.count()
    blocks = max(1, -(-n // CANDIDATES))
    asked = weights.where(F.col("id") % every == 0).groupBy("id").agg(F.max("weights").alias("weights"))
    tiles = max(1, -(-asked.count() // ASKED))
    # each query block meets each candidate block in a tile of bounded size, however many rows there are
    deal = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asked.select("id", "weights", deal(F.xxhash64("id"), tiles).alias("tile"), every_of(blocks).alias("block"))
    held = weights.select("id", "weights", deal(F.xxhash64("id", F.monotonically_increasing_id()), blocks).alias("block"), every_of(tiles).alias("tile"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
        q, r, s = [], [], []
        for hi in range(0, len(ids), CANDIDATES):
            cand, cand_ids = _matrix(left.column("weights").slice(hi, CANDIDATES).to_pylist()), ids[hi : hi + CANDIDATES]
            for lo in range(0, len(own), QUERIES):
                total = scores(_matrix(right.column("weights").slice(lo, QUERIES).to_pylist()), cand)
                rows, cols = best(total, cand_ids, own[lo : lo + QUERIES], k)
                q.append(own[lo : lo + QUERIES][rows])
                r.append(cand_ids[cols])
                s.append(total[rows, cols].astype(np.int64))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(q or empty), "vec_id": np.concatenate(r or empty), "score": np.concatenate(s or empty)})

    parts = held.groupBy("block", "tile").cogroup(asks.groupBy("block", "tile")).applyInArrow(product, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every embedding whose id is divisible by 50."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
