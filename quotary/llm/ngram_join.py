"""Exact Jaccard similarity join on word n-grams: a blocked sparse product of the document by n-gram incidence.

Documents x n-grams is a sparse 0/1 matrix; the product with its transpose holds all overlap counts. Only parts of it
can reach the threshold, and size-derived bounds say which: of a row with s n-grams, a partner shares m of any
s - ceil(t * s) + m of them. Each row so contributes only its rarest columns to the search for blocks, and rows that
meet others in fewer than m of those are left out; the columns' global order is by a sketch of their frequency, so
columns that many rows share come last. Rows that meet in a column
form blocks, a block's product is accumulated over column blocks in numpy, and what stays below the overlap that two
sizes demand is discarded. Equal rows are collapsed first, and links inside one component need not be known, so a group
of copies costs links in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import components, discard, materialize, table
from quotary.llm.shingles import binary, mixed, shingle_sets, slices

#: Counters of the frequency sketch: 2 MB, whatever the input.
SKETCH_BITS = 18
#: Most rows of one block of the product, and its columns at a time: 4 MB dense.
BLOCK_ROWS, BLOCK_COLUMNS = 256, 4096
#: Rows of a block of candidates; rows of an n-gram up to which it's tried whether any of them may link.
PAIR_ROWS, SMALL = 1024, 64
#: Bits of a row's parity, whole 64-bit words: of all its n-grams, and of those that other rows have too.
PARITY_BITS, MARK_BITS = 256, 512


def least_shared(size, num: int, den: int):
    """m: of its rarest columns, so many must be shared for a link; a fixed part of what a row may differ in."""
    return size * (den - num) // (4 * den) + 1


def _sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """How many rows hold an n-gram of each hash bucket: one fixed-size array, summed over all tasks."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, text=text):
                for _, h, _ in shingle_sets(binary(batch.column(text)), n):
                    total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    got = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)  # bounded: 2^SKETCH_BITS counters at most
    sketch[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return sketch


def _rows(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, sketch) -> DataFrame:
    """(doc, size, s1, s2, prefix, parity): set size, 128 bits that stand for the set, its rarest n-grams as packed hashes
    and its parity; without a sketch the last two are empty."""

    def rows(batches):
        counts = sketch.value if sketch else None
        for whole in batches:
            for batch in slices(whole, text=text):
                ids = batch.column(key)
                for at, h, sizes in shingle_sets(binary(batch.column(text)), n):
                    ends = np.cumsum(sizes)
                    sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(c)), dtype=np.uint64)])[np.concatenate([[0], ends])]) for c in (1, 2)]
                    packed, marks = [b""] * len(sizes), [b""] * len(sizes)
                    if counts is not None and len(h):
                        marks = [x.tobytes() for x in parity(h, sizes)]
                        owner = np.repeat(np.arange(len(sizes)), sizes)
                        h = h[np.lexsort((h, counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))]
                        keep = sizes - -(-sizes * num // den) + least_shared(sizes, num, den)
                        packed = [h[e - s : e - s + k].tobytes() if s else b"" for e, s, k in zip(ends, sizes, keep, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(packed, pa.binary()), pa.array(marks, pa.binary())],
                        names=["doc", "size", "s1", "s2", "prefix", "parity"],
                    )

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(rows, "doc long, size long, s1 long, s2 long, prefix binary, parity binary")


def _unpacked(reps: DataFrame) -> DataFrame:
    """(gram, doc, size): the prefixes of packed hashes, one row each."""

    def unpack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                grams = [np.frombuffer(p, np.int64) for p in part.column("prefix").to_pylist()]
                n = np.array([len(g) for g in grams], np.int64)
                if n.sum():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(grams)), pa.array(np.repeat(part.column("doc").to_numpy(), n)), pa.array(np.repeat(part.column("size").to_numpy(), n))], names=["gram", "doc", "size"]
                    )

    return reps.select("doc", "size", "prefix").mapInArrow(unpack, "gram long, doc long, size long")


def _meetings(reps: DataFrame) -> DataFrame:
    """(gram, doc, size, n) of the prefixes, of n-grams in which at least two rows meet; n is the number of these rows, as far as
    SMALL + 1. One shuffle and a sort that spills; the sorted rows stream past, SMALL of them held at most."""
    names = ["gram", "doc", "size"]

    def emit(rows: list[np.ndarray], n: np.ndarray):
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(n.astype(np.int64))], names=[*names, "n"])

    def shared(batches):
        held, big = None, None  # rows of the last n-gram while they're few; the n-gram that has many
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
            size = np.diff(np.append(edge, len(cols[0])))
            if big is not None and cols[0][0] == big:
                size[0] += SMALL
            last = size[-1]
            big = cols[0][-1] if last > SMALL else None
            n = np.repeat(np.minimum(size, SMALL + 1), np.diff(np.append(edge, len(cols[0]))))
            to = len(n) if big is not None else edge[-1]
            held = None if big is not None else [x[to:] for x in cols]
            keep = np.flatnonzero(n[:to] > 1)
            if len(keep):
                yield emit([x[keep] for x in cols], n[keep])
        if held is not None and len(held[0]) > 1:
            yield emit(held, np.full(len(held[0]), len(held[0])))

    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _unpacked(reps).repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(shared, "gram long, doc long, size long, n long")


def _promising(meetings: DataFrame, num: int, den: int) -> DataFrame:
    """The meetings of rows that meet others often enough. A partner may be smaller and then need fewer, hence the bound."""
    smallest = F.ceil(F.col("size") * num / den)
    need = F.floor(smallest * (den - num) / (4 * den)) + 1
    often = meetings.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    return meetings.join(often.select("doc", "size"), ["doc", "size"], "left_semi").select("gram", "doc", "size", "n")


def _enough(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of pairs(a, b, size), one row for each meeting, that meet in as many columns as the smaller size demands."""
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    return met.where(F.col("n") >= F.floor(F.col("size") * (den - num) / (4 * den)) + 1).select("a", "b")


def _labelled(meetings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """meetings with `comp`: the component that a row is known to be of, its own id at first."""
    if labels is None:
        return meetings.withColumn("comp", F.col("doc"))
    return meetings.join(labels, meetings.doc == labels.node, "left").select(*meetings.columns, F.coalesce("component", "doc").alias("comp"))


def _hub_pairs(meetings: DataFrame, labels: DataFrame | None, num: int, den: int, seeds: tuple[int, ...], enough: bool = True) -> DataFrame:
    """(a, b): in each n-gram, each row with a few rows that all its rows are compared with: the one with the fewest
    n-grams of its own (in a group of edited copies, the least edited one: what links with any links with it) and,
    for each seed, a random one.

    `meetings(gram, doc, size, own)`. Rows whose component is known to be the same, or whose sizes rule a link out, don't
    pair. A grouped minimum finds the hubs and an equi-join brings them, so the cost is in proportion to the rows however
    large a group is. This finds most links; _left_pairs finds the rest.
    """
    rows = _labelled(meetings, labels)
    me = F.struct("doc", "size", "comp")
    hubs = [F.min_by(me, F.struct("own", "doc")), *[F.min_by(me, F.xxhash64(F.lit(x), "doc")) for x in seeds]]
    groups = rows.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(*hubs)).alias("hubs")).where("lo <> hi").select("gram", "hubs")
    met = rows.join(groups, "gram").select("doc", "size", "comp", F.explode("hubs").alias("hub")).where("doc <> hub.doc and comp <> hub.comp")
    fits = F.least("size", "hub.size") * den >= F.greatest("size", "hub.size") * num
    met = met.where(fits).select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b"), F.least("size", "hub.size").alias("size"))
    return _enough(met, num, den) if enough else met.select("a", "b").distinct()


def parity(h: np.ndarray, sizes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """So many bits a set: each n-gram flips one. Where two sets' bits differ, at least one n-gram differs."""
    out = np.zeros((len(sizes), bits), np.uint8)
    np.add.at(out, (np.repeat(np.arange(len(sizes)), sizes), (h % np.uint64(bits)).astype(np.int64)), 1)
    return np.packbits(out & 1, axis=1)


def _marks(sets: DataFrame) -> DataFrame:
    """(doc, size, own, parity) of sets(doc, size, parity, grams): how many of a row's n-grams no other row has, and the parity
    of the others. What two rows have of their own differs for certain, and so do as many of the others as their parities
    tell. Of a key with several texts none are taken for its own.

    One half of the hashes is counted after the other, so no more than half of the n-grams lie shuffled at a time, and a row's own
    ones are told by their number and parity alone."""
    words = [f"w{i}" for i in range(MARK_BITS // 64)]
    flip = F.expr("shiftleft(1L, cast(gram & 63 as int))")
    flips = [F.coalesce(F.bit_xor(F.when(F.expr(f"shiftright(gram, 6) & {len(words) - 1}") == i, flip)), F.lit(0)).alias(w) for i, w in enumerate(words)]

    def unpack(batches, below: bool):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                grams = [np.frombuffer(g, np.int64) for g in part.column("grams").to_pylist()]
                grams = [g[(g < 0) == below] for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.repeat(part.column("doc").to_numpy(), [len(g) for g in grams]))], names=["gram", "doc"])

    def mark(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own = np.stack([part.column(w).to_numpy() for w in words], axis=1).astype("<i8").view(np.uint8)
                bits = np.frombuffer(b"".join(part.column("parity").to_pylist()), np.uint8).reshape(len(own), -1) ^ np.packbits(np.unpackbits(own, axis=1, bitorder="little"), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("size"), part.column("own"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc", "size", "own", "parity"])

    several = sets.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    halves = []
    for below in (True, False):
        held = sets.select("doc", "grams").mapInArrow(lambda batches, below=below: unpack(batches, below), "gram long, doc long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
        halves.append(materialize(held.where("n = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("own"), *flips), "own"))
    own = halves[0].unionByName(halves[1]).groupBy("doc").agg(F.sum("own").alias("own"), *[F.bit_xor(w).alias(w) for w in words]).join(several, "doc", "left_anti")
    known = sets.select("doc", "size", "parity").join(own, "doc", "left").select("doc", "size", "parity", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("own", *words)])
    marks = materialize(known.mapInArrow(mark, "doc long, size long, own long, parity binary"), "marks")
    discard(*halves)
    return marks


def _dealt(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows(gram, doc, comp, ...) with the block pairs (x, y) of their n-gram in which they're compared, by size.

    groups(gram, n, main, n_main): a group of up to PAIR_ROWS rows is one block. Of a larger one, the rows of its largest
    component, which need no comparing with each other, and the others are dealt into blocks apart; a block of the others
    meets every block. So no task holds more than two blocks at once, and few strangers in a large group cost little.
    """
    dealt = F.lit(PAIR_ROWS)
    of_main = F.when(F.col("n") <= dealt, 0).otherwise(F.ceil(F.col("n_main") / dealt)).cast("int")
    of_rest = F.when(F.col("n") <= dealt, 1).otherwise(F.ceil((F.col("n") - F.col("n_main")) / dealt)).cast("int")
    d = rows.join(groups.select("gram", "main", of_main.alias("of_main"), of_rest.alias("of_rest")), "gram")
    in_main = (F.col("of_main") > 0) & (F.col("comp") == F.col("main"))
    spread = F.xxhash64("doc")
    d = d.withColumn("i", F.when(in_main, F.pmod(spread, F.greatest("of_main", F.lit(1)))).otherwise(F.col("of_main") + F.pmod(spread, F.col("of_rest"))).cast("int"))
    d = d.withColumn("j", F.explode(F.sequence(F.when(in_main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)))
    d = d.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")}).drop("of_main", "of_rest", "main", "j")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(n, "gram", "x", "y").sortWithinPartitions("gram", "x", "y", "size")


def _whole_groups(batches):
    """Arrow tables of whole groups (gram, x, y), from batches in their order: the last group waits for its rest."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        keys = [t.column(c).to_numpy() for c in ("gram", "x", "y")]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks()
    if held is not None:
        yield held


def _passing(t: pa.Table, num: int, den: int, apart: np.ndarray | None = None):
    """(i, j) arrays of the rows of one group that may link: sizes within the threshold of each other, not both of one
    block of two, of different `apart` values, and by own n-grams and parities no more n-grams differ than a link allows."""
    g, x, y, side, doc, size, own = (t.column(c).to_numpy() for c in ("gram", "x", "y", "i", "doc", "size", "own"))
    bits = np.frombuffer(b"".join(t.column("parity").to_pylist()), np.uint64).reshape(len(g), -1)
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.cumsum(first)
    live, k = np.arange(len(g)), 0
    while len(live):
        k += 1
        live = live[live + k < len(g)]
        j = live + k
        live = live[(group[j] == group[live]) & (size[j] * num <= size[live] * den)]  # by size: beyond it none fits
        i, j = live, live + k
        # a link has an overlap of t / (1 + t) of both sizes, so at most this many n-grams differ
        both = size[i] + size[j]
        spare = both - 2 * -(-both * num // (num + den)) - own[i] - own[j]
        ok = (spare >= 0) & (doc[i] != doc[j]) & ((x[i] == y[i]) | (side[i] != side[j]))
        if apart is not None:
            ok &= apart[i] != apart[j]
        i, j = i[ok], j[ok]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= spare[ok]
        if near.any():
            yield i[near], j[near]


def _near_rows(meetings: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(doc): the rows that meet one in some n-gram to which, by sizes and parities, they may be linked; rows of n-grams
    with more than SMALL rows stay untried. marks(doc, size, own, parity)."""
    def near(batches):
        for t in _whole_groups(batches):
            docs = t.column("doc").to_numpy()
            found = np.zeros(len(docs), bool)
            for i, j in _passing(t, num, den):
                found[i] = found[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(docs[found]))], names=["doc"])

    tried = meetings.where(F.col("n") <= SMALL).join(marks, ["doc", "size"])
    tried = tried.select("gram", "doc", "size", "own", "parity", *[F.lit(0).alias(c) for c in "ixy"])
    n = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tried.repartition(n, "gram").sortWithinPartitions("gram", "size").mapInArrow(near, "doc long")
    return found.unionByName(meetings.where(F.col("n") > SMALL).select("doc")).distinct()


def _left_pairs(meetings: DataFrame, labels: DataFrame, marks: DataFrame, num: int, den: int, enough: bool = True) -> DataFrame:
    """(a, b): all pairs that meet in an n-gram, pass the size-derived bounds and may still link two components.

    n-grams whose rows are of one component are done: rows of two components share none of those, so the others tell in
    how many n-grams a pair meets, and pairs that meet too rarely are out. Without `enough` one meeting will do.
    """
    rows = _labelled(meetings.select("gram", "doc", "size"), labels)
    by = rows.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"))
    groups = by.groupBy("gram").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    groups = groups.select("gram", "n", F.col("top.comp").alias("main"), F.col("top.k").alias("n_main"))

    def pairs(batches):
        for t in _whole_groups(batches):
            doc, size, comp = (t.column(c).to_numpy() for c in ("doc", "size", "comp"))
            met = [np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.minimum(size[i], size[j])], axis=1) for i, j in _passing(t, num, den, comp)]
            if met:
                got, n = np.unique(np.concatenate(met), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(got[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], names=["a", "b", "size", "n"])

    open_rows = rows.join(groups.select("gram"), "gram", "left_semi")
    met = _dealt(open_rows.join(marks, ["doc", "size"]), groups).mapInArrow(pairs, "a long, b long, size long, n long")
    if not enough:
        return met.select("a", "b").distinct()
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    return met.where(F.col("n") >= F.floor(F.col("size") * (den - num) / (4 * den)) + 1).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of a block's incidence with its transpose: overlap counts of all its rows.

    Columns with one row add nothing off the diagonal and are left out; the others are taken BLOCK_COLUMNS at a time.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(rows):
        return np.zeros((len(sets), len(sets)), np.int64)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, column = rows[n[column] > 1], column[n[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + BLOCK_COLUMNS))
        dense = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
        dense[rows[a:b], column[a:b] - lo] = 1
        total += dense @ dense.T
    total = np.rint(total).astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): of the candidate pairs' blocks, links that connect what the block's links connect.

    A block is a row with up to BLOCK_ROWS - 1 of its partners; a row with more has several blocks.
    """
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(fan, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") * 2 / BLOCK_ROWS)).cast("int"))
    dealt = materialize(dealt.select("a", "b", "part"), "pairs")
    members = dealt.select("a", "part", F.col("b").alias("doc")).unionByName(dealt.select("a", "part", F.col("a").alias("doc")).distinct())

    def product(group: pa.Table) -> pa.Table:
        ids = group.column("doc").to_numpy()
        packed = group.column("grams").to_pylist()
        a, b = [], []
        top = np.arange(len(ids))
        for lo in range(0, len(ids), BLOCK_ROWS):  # a part that hashing made larger is taken in blocks, pair by pair of blocks
            for lo2 in range(lo, len(ids), BLOCK_ROWS):
                at = np.unique(np.concatenate([np.arange(lo, min(lo + BLOCK_ROWS, len(ids))), np.arange(lo2, min(lo2 + BLOCK_ROWS, len(ids)))]))
                rows = [np.frombuffer(packed[i], np.int64) for i in at]
                both, size = overlaps(rows), np.array([len(r) for r in rows])
                union = size[:, None] + size[None, :] - both
                for i, j in zip(*np.nonzero(np.triu((both * den >= union * num) & (both > 0), 1)), strict=True):
                    i, j = at[i], at[j]
                    while top[i] != i:
                        i = top[i]
                    while top[j] != j:
                        j = top[j]
                    if i != j:
                        top[max(i, j)] = min(i, j)
                        a.append(ids[min(i, j)])
                        b.append(ids[max(i, j)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.join(sets.select("doc", "grams"), "doc").groupBy("a", "part").applyInArrow(product, "a long, b long").where("a <> b").distinct()


def similar_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs: classes of texts linked by Jaccard >= num / den.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a row's set is its distinct n-word shingles, or
    the whole sequence if it has fewer words. Rows without words, null texts among them, have the empty set and link with
    nothing: their component is their own key. Rows that share a key are one document with several texts. A row whose
    key is null can't be named as a partner: its component is null. Equal texts link. An empty table gives an empty
    result; other columns of docs are not read. Exact: no link between different texts is missed, as every pair that
    meets the size-derived bounds is either inside a component already or verified.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    sketch = spark.sparkContext.broadcast(_sketch(slim, "_text", n))
    # equal sets are one row of the matrix; its name is the smallest key
    reps = _rows(slim, "_doc", "_text", n, num, den, sketch).where("size > 0 and doc is not null")
    reps = reps.groupBy("size", "s1", "s2").agg(F.min("doc").alias("doc"), F.min_by(F.struct("prefix", "parity"), "doc").alias("r"))
    whole = materialize(reps.select("size", "s1", "s2", "doc", "r.prefix", "r.parity"), "rows")
    every = materialize(_meetings(whole), "meetings")
    reps = materialize(whole.drop("prefix"), "rows")
    discard(whole)
    meetings = materialize(_promising(every, num, den), "meetings")
    discard(every)
    marks = reps.select("doc", "size", F.lit(0).cast("long").alias("own"), "parity")  # two rows for a key with two texts: both are tried
    near = materialize(_near_rows(meetings, marks, num, den), "near")
    wanted = near.select(F.col("doc").alias("_doc"))

    def pack(batches):
        for whole in batches:
            for batch in slices(whole, text="_text"):
                ids = batch.column("_doc")
                for at, h, sizes in shingle_sets(binary(batch.column("_text")), n):
                    ends = np.cumsum(sizes)
                    grams, marks = [h[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)], [x.tobytes() for x in parity(h, sizes, MARK_BITS)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes.astype(np.int64)), pa.array(marks, pa.binary()), pa.array(grams, pa.binary())], names=["doc", "size", "parity", "grams"])

    sets = materialize(slim.join(wanted, "_doc", "left_semi").select("_doc", "_text").mapInArrow(pack, "doc long, size long, parity binary, grams binary"), "sets")
    marks = _marks(sets.where("size > 0"))
    discard(near)
    open_ = meetings
    meetings = materialize(open_.join(marks.select("doc", "size", "own"), ["doc", "size"]).select("gram", "doc", "size", "own"), "meetings")
    discard(open_)
    member = materialize(_rows(slim, "_doc", "_text", n, num, den, None).drop("prefix", "parity"), "members")
    named = member.where("size > 0 and doc is not null")
    rep = reps.select("size", "s1", "s2", F.col("doc").alias("rep"))
    links, labels = None, None
    # a key with several texts ties their classes together
    several = named.groupBy("doc").agg(F.count_distinct("size", "s1", "s2").alias("n")).where("n > 1").select("doc")
    tied = named.join(several, "doc", "left_semi").join(rep, ["size", "s1", "s2"]).select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    for seeds in ((1,), (2, 3, 4), ()):
        labels = materialize(components(links), "labels") if links is not None else None
        pairs = _hub_pairs(meetings, labels, num, den, seeds) if seeds else _left_pairs(meetings, labels, marks, num, den)
        found = _links(pairs, sets, num, den)
        more = materialize(found.unionByName(links if links is not None else tied), "links")
        discard(links, labels)
        links = more
    labels = components(links)
    discard(meetings, marks, sets)
    out = member.join(rep, ["size", "s1", "s2"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    alone = F.when(F.col("size") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("doc").isNotNull(), alone).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at a Jaccard similarity of 0.9 or more."""
    return similar_components(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
