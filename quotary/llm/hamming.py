"""Nearest neighbours by multi-index hashing (Norouzi et al. 2012).

Vectors get binary codes: signs after rotations that are learned to lie close to the data (iterative quantisation, Gong and
Lazebnik 2011). A code is split into substrings and each substring is indexed; a code within a radius of the query's agrees
with it in one substring up to the radius' share of it (the pigeonhole principle), so probing all substrings within
their shares retrieves every code within the radius. What is retrieved is ranked again by its vectors.

The index lives in blocks of rows, the queries in tiles, and each tile meets each block in one group of bounded size that
probes the block's index; a query's parts are merged over k rows a block. Copies of one vector are rows of blocks
like all others, so no bucket of equal codes is one task's work.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table

#: Queries are the rows whose id is divisible by EVERY; TOP neighbours are found for each.
EVERY, TOP = 20, 20
#: Bits of a code, of its substrings, and rounds of the rotation's fit.
BITS, PART, ROUNDS = 256, 16, 30
#: Rows, chosen by a hash, from which rotations are learned, and queries from whose true neighbours the radius is learned.
FITTED, ASKED = 5000, 64
#: The radius holds this part of a query's true neighbours, for this part of the queries looked at.
SHARE = 0.95
#: Numbers in a block's vectors, rows in a block at most, queries in a tile, and queries probed at a time.
BLOCK, ROWS, TILE, AT_ONCE = 1 << 20, 16_384, 8192, 16
#: Scores by matrix products lie this close to those added up in order, as a part of the vectors' lengths.
CLOSE = 1e-10


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, norm): rows whose vector isn't null or zero and holds no null or non-finite component, under a key."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(x, lambda v: v != 0))
    return rows.select(F.col(key).cast("long").alias("id"), x.alias("v"), norm.alias("norm"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of components, shorter ones filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    length = np.diff(offsets)
    if len(length) and (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], length)] = flat
    return out


def rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Iterative quantisation: a random rotation, then in turns the nearest corners of the cube and the rotation that
    brings the points closest to them."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
        turn = (u @ w).T
    return turn


class Coder:
    """Codes of rows and of queries.

    Rows get one component more, the root of (the longest row's square - their own square), and then all have one length: the
    order of inner products with a query, whose component there is 0, is the order of angles. Rows are centred; a query
    isn't, as the centre adds the same to all its products.
    """

    def __init__(self, sample: np.ndarray, longest: float, bits: int = BITS, part: int = PART):
        self.longest, self.part = longest, part
        rows = self.lengthened(sample)
        self.centre = rows.mean(0)
        centred = rows - self.centre
        values, axes = np.linalg.eigh(centred.T @ centred / max(1, len(rows)))
        use = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-300))[::-1][:bits]  # the directions in which rows differ at all
        axes = axes[:, use if len(use) else [-1]]
        turns = [rotation(centred @ axes, seed) for seed in range(-(-bits // axes.shape[1]))]
        self.turn = np.hstack([axes @ t for t in turns])[:, :bits]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]])

    def _packed(self, signs: np.ndarray) -> np.ndarray:
        return np.packbits(signs, axis=1).view(np.uint16 if self.part == 16 else np.uint8)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self._packed((self.lengthened(x) - self.centre) @ self.turn > 0)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self._packed(x @ self.turn[:-1] > 0)


@functools.lru_cache(64)
def ball(part: int, radius: int) -> np.ndarray:
    """All values of `part` bits with at most `radius` ones."""
    every = np.arange(1 << part, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius].astype(np.uint16 if part == 16 else np.uint8)


#: Values that are gone through in the time of looking one up.
SEEK = 32


def ball_size(part: int, radius: int) -> int:
    return sum(math.comb(part, i) for i in range(radius + 1))


class Index:
    """A block's codes by the values of each substring: for each, its values, and the rows that have them."""

    def __init__(self, codes: np.ndarray, part: int = PART):
        self.part = part
        self.columns = np.ascontiguousarray(codes.T)
        self.whole = np.ascontiguousarray(codes.view(np.uint64).T)
        self.rows = np.argsort(self.columns, axis=1, kind="stable")
        ordered = np.take_along_axis(self.columns, self.rows, 1)
        self.starts = [np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]])) for o in ordered]
        self.values = [o[s[:-1]] for o, s in zip(ordered, self.starts, strict=True)]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of every code within the radius of the query's.

        With m substrings and radius = a * m + b, a code within it differs in at most a bits in one of the first b + 1
        substrings, or in fewer than a in one of the others: else it differed in more than the radius in all.
        """
        m, n = self.columns.shape
        share, more = divmod(radius, m)
        hit = np.zeros(n, bool)
        for t in range(m):
            r = share if t <= more else share - 1
            if r < 0:
                break
            values = self.values[t]
            if ball_size(self.part, r) * SEEK < n:  # look the probes up
                probes = ball(self.part, r) ^ query[t]
                at = np.searchsorted(values, probes)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
                for a in at:
                    hit[self.rows[t, self.starts[t][a] : self.starts[t][a + 1]]] = True
            else:  # so many probes take longer than going through the values, row by row
                hit |= np.bitwise_count(self.columns[t] ^ query[t]) <= r
        few = 4 * np.count_nonzero(hit) < n
        rows = np.flatnonzero(hit) if few else slice(None)
        far = np.zeros(n, np.uint16) if not few else np.zeros(len(rows), np.uint16)
        for column, q in zip(self.whole, query.view(np.uint64), strict=True):
            far += np.bitwise_count(column[rows] ^ q)
        near = np.flatnonzero(far <= radius) if few else np.flatnonzero((far <= radius) & hit)
        return (rows[near] if few else near), far[near].astype(np.int64)


def in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, added up component by component: equal vectors have equal scores wherever they stand."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * q[d]
    return total


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k largest products with a query, ties to smaller ids; rows of the query's own id take no part."""
    use = np.flatnonzero(ids != own)
    if len(use) > k:  # leave out what is surely too small
        rough = x[use] @ q
        edge = np.partition(rough, len(use) - k)[len(use) - k]
        use = use[rough >= edge - CLOSE * max(1e-300, float(np.abs(rough).max()) + float(np.abs(q).sum() * np.abs(x[use]).max()))]
    score = in_order(x[use], q)
    order = np.lexsort((ids[use], -score))[:k]
    return use[order], score[order]


def learn(rows: DataFrame, asked: DataFrame, width: int, longest: float, k: int, bits: int, part: int) -> tuple[Coder, int]:
    """The coder, from FITTED rows, and the radius, from the true neighbours among all rows of ASKED queries with different vectors.

    Both samples are the rows whose ids have the smallest hashes. The radius grows and shrinks with the table, as neighbours
    come closer in a larger one.
    """
    some = lambda df, n: np.unique(matrix(pa.array([r["v"] for r in df.orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()], pa.list_(pa.float64())), width), axis=0)
    coder, queries = Coder(some(rows, FITTED), longest, bits, part), some(asked.select("id", "v"), ASKED)
    codes = coder.queries(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 2)) for _ in queries]
        for batch in batches:
            x = matrix(batch.column(0), width)
            product, code = x @ queries.T, coder.rows(x)
            for i in range(len(queries)):
                # the query's own row and its copies tell nothing of how far neighbours' codes are
                other = np.flatnonzero((x != queries[i]).any(1))
                top = other[np.argsort(-product[other, i], kind="stable")[:k]]
                far = np.bitwise_count(code[top].view(np.uint64) ^ codes[i].view(np.uint64)).sum(1, dtype=np.int64)
                both = np.concatenate([held[i], np.stack([product[top, i], far], axis=1)])
                held[i] = both[np.argsort(-both[:, 0], kind="stable")[:k]]
        every = np.concatenate(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), [len(h) for h in held]), pa.int32()), pa.array(every[:, 0]), pa.array(every[:, 1].astype(np.int32))], ["q", "score", "far"])

    found = rows.select("v").mapInArrow(scan, "q int, score double, far int")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))).where(F.col("r") <= k)
    need = [np.quantile(r["far"], SHARE, method="higher") for r in top.groupBy("q").agg(F.collect_list("far").alias("far")).collect()]  # k numbers for each of ASKED queries
    return coder, int(np.quantile(need, SHARE, method="higher")) if need else bits


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = TOP, bits: int = BITS, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k nearest rows found, by inner
    product in double precision, ties to the smaller key; all others, if they are fewer.

    Every row is indexed. A block in which fewer than k codes lie within the radius is probed at wider ones until k do, so each
    query has k results. Keys name rows: rows that repeat a key are candidates each, never of a query of their own key, and
    such a query is asked once, by its greatest vector in order of components. A vector that lacks components of a
    query has 0 there. Vectors that are null, zero, or hold a null or non-finite component, and rows with a null key, take no
    part. Components beyond about 1e150 overflow double precision's products and are an error. Other columns aren't read. An empty table, or one
    without queries, gives an empty result.
    """
    if bits % 64 or part not in (8, 16):
        raise ValueError("bits come in steps of 64, substrings have 8 or 16")
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors, key, vector), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("longest")).first()
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.max("v").alias("v"))
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    width, longest = facts["width"], facts["longest"]
    if not math.isfinite(longest):
        raise ValueError("components are too large for products in double precision")
    coder, radius = learn(rows, asked, width, longest, k, bits, part)

    def coded(encode):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = encode(matrix(batch.column("v"), width))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "code"])

        return run

    shape = "id long, v array<double>, code binary"
    per_block = max(256, min(ROWS, BLOCK // width))
    blocks, tiles = max(1, -(-facts["n"] // per_block)), max(1, -(-n_asked // TILE))
    deal = lambda key, n: F.pmod(key, F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("id", "v").mapInArrow(coded(coder.rows), shape)
    held = index.select("*", deal(F.xxhash64("id", F.monotonically_increasing_id()), blocks).alias("block"), every_of(tiles).alias("tile"))
    probes = asked.select("id", "v").mapInArrow(coded(coder.queries), shape).select("*", deal(F.xxhash64("id"), tiles).alias("tile"), every_of(blocks).alias("block"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r, s = [], [], []
        if left.num_rows:
            codes = lambda t: np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, bits // 8).view(np.uint16 if part == 16 else np.uint8)
            x, ids, index = matrix(left.column("v"), width), left.column("id").to_numpy(), Index(codes(left), part)
            least = min(k + 1, len(ids))
            for v, own, code in zip(matrix(right.column("v"), width), right.column("id").to_numpy(), codes(right), strict=True):
                reach = radius
                found, _ = index.within(code, reach)
                while (ids[found] != own).sum() < least and reach < bits:
                    reach = min(bits, reach + max(1, reach // 4))
                    found, _ = index.within(code, reach)
                top, score = best(x[found], ids[found], v, own, k)
                q.append(np.full(len(top), own)), r.append(ids[found][top]), s.append(score)
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(q or empty), "vec_id": np.concatenate(r or empty), "score": np.concatenate(s or [np.zeros(0)])})

    parts = held.groupBy("block", "tile").cogroup(probes.groupBy("block", "tile")).applyInArrow(probe, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every embedding whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
