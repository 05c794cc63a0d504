"""Substring dedup: passages that repeat across documents, in whole or nearly.

Paragraphs of two kinds are compared. Lines: a line of some length, or short lines that follow each other packed to that
length; their MinHash signatures are cut into bands that are tuned for high recall, paragraphs that share a band are
joined, their exact Jaccard similarity is verified in blocks, and links form clusters by connected components. Windows: so
many words from each of the places that the words themselves determine, wherever the lines end, so a passage in the midst
of other text has the same windows everywhere. An edit inside so short a window leaves it far under the threshold, so a
window's one band is its whole signature: equal windows are one cluster. In each cluster the smallest document keeps its
paragraphs, those of the others are marked, and marked stretches are the removals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.llm.common import components, materialize, table
from quotary.llm.ngram_join import MARK_BITS, _hub_pairs, _left_pairs, _links, _meetings, parity
from quotary.llm.shingles import binary, mixed, shingle_sets, slices, word_hashes

#: Words of a shingle and the similarity of near-duplicate paragraphs, as num / den.
SHINGLE, NUM, DEN = 5, 4, 5
#: Least words of a paragraph, least words of a removed stretch, words that two marked units of one stretch may lie apart.
PARAGRAPH, STRETCH, GAP = 20, 20, 2
#: A window begins where a word pair's hash is the least among so many places before and after: every 13 words or so.
REACH = 6
#: Least share of pairs at the threshold that some band brings together.
RECALL = 0.995


def tune(similarity: float, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """(bands, rows of a band): the longest bands, so the fewest false meetings, that reach the recall with at most
    `most` hash values in all."""
    best = (1, 1)
    for rows in range(1, 9):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall:
            bands += 1
        if bands * rows <= most and rows >= best[1]:
            best = (bands, rows)
    return best


#: Hash values of a signature: 8 bands of 3, at the threshold above.
BANDS, ROWS = tune(NUM / DEN, most=32)


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band keys, sets x BANDS, of non-empty sets of shingle hashes that lie one after the other."""
    first = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sizes), b + 1, np.uint64)
        for r in range(ROWS):
            least = np.minimum.reduceat(mixed(h ^ np.uint64((b * ROWS + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), first)
            key = mixed(key * np.uint64(31) + least)
        out[:, b] = key
    return out


def window_starts(h: np.ndarray) -> np.ndarray:
    """Places at which windows begin: local minima of the hashes of word pairs. Only REACH words to either side decide."""
    if len(h) < 2 * REACH + 2:
        return np.zeros(0, np.int64)
    pair = mixed(h[:-1] * np.uint64(3) + h[1:])
    windows = np.lib.stride_tricks.sliding_window_view(pair, REACH).min(axis=1)
    here = pair[REACH:-REACH]
    # of equal hashes in reach none is a start but the first: words repeated over and over have few windows
    return np.flatnonzero((here < windows[: len(here)]) & (here <= windows[REACH + 1 :])) + REACH


def _windows(docs: DataFrame) -> DataFrame:
    """(doc, start, s1, s2): the windows of PARAGRAPH words, by two hashes of their words."""

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                for at, words, counts in word_hashes(binary(batch.column("text"))):
                    doc, start, first = [], [], []
                    lo = 0
                    for i, n in enumerate(counts):
                        s = window_starts(words[lo : lo + n])
                        s = s[s + PARAGRAPH <= n]
                        doc.append(np.full(len(s), ids[at + i]))
                        start.append(s)
                        first.append(s + lo)
                        lo += n
                    first = np.concatenate(first)
                    one, two = (np.full(len(first), c, np.uint64) for c in (1, 2))
                    for k in range(PARAGRAPH):
                        one = mixed(one * np.uint64(31) + words[first + k])
                        two += mixed(words[first + k] ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc).astype(np.int64)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc", "start", "s1", "s2"])

    return docs.mapInArrow(cut, "doc long, start int, s1 long, s2 long")


def lines(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first word, end, text) of the paragraphs of PARAGRAPH words or more: lines, and runs of shorter ones, each closed as
    soon as it has so many."""
    out, held, at, first = [], [], 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n >= PARAGRAPH:
            held = []
            out.append((at, at + n, line))
        elif n:
            first = first if held else at
            held.append(line)
            if at + n - first >= PARAGRAPH:
                out.append((first, at + n, b" ".join(held)))
                held = []
        at += n
    return out


def _paragraphs(docs: DataFrame, what: str) -> DataFrame:
    """The lines of PARAGRAPH words or more: (doc, start, end, size, s1, s2, prefix) with packed band keys, or (size, s1, s2,
    grams, parity) with packed shingles. s1 and s2 stand for the set of shingles."""
    places = what == "bands"

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                found = [(d, *x) for d, text in zip(batch.column("doc").to_pylist(), binary(batch.column("text")), strict=True) for x in lines(text)]
                doc, start, end, held = zip(*found, strict=True) if found else ((), (), (), ())
                for at, h, sizes in shingle_sets(list(held), SHINGLE):
                    ends = np.cumsum(sizes)
                    sums = []
                    for c in (1, 2):
                        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(c)), dtype=np.uint64)])
                        sums.append(pa.array((total[ends] - total[ends - sizes]).view(np.int64)))
                    size = pa.array(sizes.astype(np.int64))
                    if places:
                        keys = [x.tobytes() for x in signatures(h, sizes)]
                        cells = [pa.array(x[at : at + len(sizes)], pa.int64()) for x in (doc, start, end)]
                        yield pa.RecordBatch.from_arrays([*cells, size, *sums, pa.array(keys, pa.binary())], names=["doc", "start", "end", "size", "s1", "s2", "prefix"])
                    else:
                        grams = [h[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                        marks = [x.tobytes() for x in parity(h, sizes, MARK_BITS)]
                        yield pa.RecordBatch.from_arrays([size, *sums, pa.array(grams, pa.binary()), pa.array(marks, pa.binary())], names=["size", "s1", "s2", "grams", "parity"])

    return docs.mapInArrow(cut, "doc long, start long, end long, size long, s1 long, s2 long, prefix binary" if places else "size long, s1 long, s2 long, grams binary, parity binary")


def _shared(units: DataFrame, cluster: list[str]) -> DataFrame:
    """units with `kept`: those whose cluster also stands in a smaller document, the one that keeps it. The smallest is
    found by a grouped minimum; clusters of one document are gone before the join."""
    kept = units.groupBy(*cluster).agg(F.min("doc").alias("kept"), F.max("doc").alias("_last")).where("kept < _last").drop("_last")
    return units.join(kept, cluster).where("doc > kept")


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, n_words, kept_id, kept_ids): stretches of words to remove, as other documents hold them.

    start and end (exclusive) count words from 0; kept_id is the smallest document that keeps a part of the stretch,
    kept_ids are all of them, no more than the stretch has paragraphs. Stretches have STRETCH words or more; a passage of
    some 50 words that stands elsewhere too is covered from its first window's start to its last one's end. A document
    without such a stretch gives no row: null and empty texts, short lines that many documents have, repeats within one
    document. Rows with a null key take no part; rows that share a key are read as texts of one document. An empty table
    gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    windows = _shared(_windows(slim), ["s1", "s2"]).select("doc", F.col("start").cast("long").alias("start"), (F.col("start") + PARAGRAPH).cast("long").alias("end"), "kept")

    found = materialize(_paragraphs(slim, "bands"), "paragraphs")
    # equal paragraphs are one node; its id is its place in the table as written
    nodes = found.groupBy("s1", "s2", "size").agg(F.min_by("prefix", "doc").alias("prefix"), F.min("doc").alias("holder"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # nodes meet in bands
    meetings = materialize(_meetings(nodes.select(F.col("node").alias("doc"), "size", "prefix")).withColumn("own", F.lit(0).cast("long")), "meetings")
    met = nodes.join(meetings.select(F.col("doc").alias("node")).distinct(), "node", "left_semi").select("s1", "s2", "node", "holder")
    sets = _paragraphs(slim.join(met.select(F.col("holder").alias("doc")).distinct(), "doc", "left_semi"), "sets").join(met.drop("holder"), ["s1", "s2"]).dropDuplicates(["node"])
    sets = materialize(sets.select(F.col("node").alias("doc"), "size", "grams", "parity"), "sets")
    marks = sets.select("doc", "size", F.lit(0).cast("long").alias("own"), "parity")
    links = None
    for seeds in ((1,), (2, 3), ()):
        labels = materialize(components(links), "labels") if links is not None else None
        pairs = _hub_pairs(meetings, labels, NUM, DEN, seeds, enough=False) if seeds else _left_pairs(meetings, labels, marks, NUM, DEN, enough=False)
        more = _links(pairs, sets, NUM, DEN)
        links = materialize(more if links is None else more.unionByName(links), "links")
    named = nodes.select("s1", "s2", "node").join(components(links).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    clustered = found.select("doc", "start", "end", "s1", "s2").join(named.select("s1", "s2", F.coalesce("component", "node").alias("cluster")), ["s1", "s2"])
    marked = _shared(clustered, ["cluster"])

    # marked units of a document that touch are one stretch
    units = windows.unionByName(marked.select("doc", "start", "end", "kept"))
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = units.withColumn("_new", F.when(F.col("start") <= reach + GAP, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = runs.groupBy("doc", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept").alias("kept_id"), F.array_sort(F.collect_set("kept")).alias("kept_ids"))
    return stretches.where(F.col("end") - F.col("start") >= STRETCH).select(F.col("doc").alias(key), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "kept_id", "kept_ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
