"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: wherever the item stands with at most k edits, one
piece at least stands there unchanged. Pieces are found by the hash of their first bytes, which a rolling hash gives at
every position of a document; a fixed-size bitmap sorts out nearly all positions before anything is shuffled, so neither
the items nor the documents are broadcast. What is found is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table
from quotary.llm.shingles import BLOCK_BYTES, binary, mixed, slices

#: Edits that an item may have: one in so many of its bytes, and so many at least.
BYTES_AN_EDIT, LEAST_EDITS = 20, 2
#: Bytes of a piece that are hashed. Items whose pieces would be shorter have fewer edits; shorter items match exactly and are
#: hashed whole.
SEED = 12
#: Bits of the bitmap of seeds: 4 MB, whatever the number of items.
BITMAP_BITS = 25
_BASE = 0x9E3779B97F4A7C15


def normal(text: bytes | None) -> bytes:
    """A-Z lower-cased, runs of blanks as one space, ends trimmed."""
    return b" ".join((text or b"").lower().split())


def budget(size: int) -> int:
    """Edits allowed for an item of `size` bytes; its pieces keep SEED bytes."""
    return max(0, min(max(LEAST_EDITS, size // BYTES_AN_EDIT), size // SEED - 1))


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the budget + 1 pieces, of nearly equal size."""
    n = budget(len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def seed_hashes(data: np.ndarray, width: int = SEED) -> np.ndarray:
    """Hash of the `width` bytes that begin at each position: a fixed polynomial, rolled by shifts of the whole array."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    total = np.full(len(data) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(_BASE) + data[i : len(data) - width + 1 + i]
    return mixed(total)


def distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """(edits, end) of the best place of item in text, the first of equals; (most + 1, -1) if none is within `most`.

    Myers 1999: a column of the edit matrix is held as two bit vectors of the item's length.
    """
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1, down << 1  # a match may begin anywhere: the first row is all 0
        plus = (down | ~(xv | up)) & mask
        minus = up & xv & mask
        if score < best:
            best, end = score, at + 1
    return best, end


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, body, seed, width, offset): each piece of each item by the hash of its first SEED bytes, or of all of a shorter
    item's. Items without text have no piece."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, body in zip(batch.column(key).to_pylist(), map(normal, binary(batch.column(text))), strict=True):
                width = min(SEED, len(body))
                if width:
                    out += [(item, body, seed_hashes(np.frombuffer(p[:width], np.uint8), width).view(np.int64)[0], width, at) for at, p in pieces(body)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["item", "body", "seed", "width", "offset"])

    return benchmark.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull()).mapInArrow(cut, "item long, body binary, seed long, width int, offset int")


def _bitmap(items: DataFrame) -> np.ndarray:
    """Which values of the top BITMAP_BITS bits of a hash some piece has; bytes of the bitmap are merged on the executors."""
    word = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    got = items.groupBy(F.shiftright(word, 3).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (word % 8).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)  # bounded: one row a byte of the bitmap at most
    bitmap[got["byte"].to_numpy().astype(np.int64)] = got["bits"].to_numpy()
    return bitmap


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, edits, budget, size): the documents in which an item stands with at most its budget of edits.

    Texts are compared as bytes, with A-Z lower-cased and blanks collapsed. One row for each pair of keys, with the
    fewest edits; documents without an item give no row. Items under 2 * SEED bytes match exactly. Null and empty texts and
    items and null keys match nothing. Rows that repeat a key count as one document, items that repeat a key as one item. An empty table on
    either side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    items = materialize(_items(benchmark, item_key, item_text), "items")
    bitmap = spark.sparkContext.broadcast(_bitmap(items.select("seed")))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # SEED of them at most
    longest = items.agg(F.max(F.octet_length("body"))).first()[0] or 0
    reach = longest + longest // BYTES_AN_EDIT + LEAST_EDITS + budget(longest)
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")

    def find(batches):
        bits = bitmap.value
        for whole in batches:
            for batch in slices(whole, BLOCK_BYTES):
                doc, seed, at, around = [], [], [], []
                bodies = [normal(t) for t in binary(batch.column("text"))]
                ids = batch.column("doc").to_pylist()
                owner = np.repeat(np.arange(len(bodies)), [len(b) + 1 for b in bodies])
                first = np.cumsum([0, *[len(b) + 1 for b in bodies]])
                for width in widths:
                    h = seed_hashes(np.frombuffer(b"\xff".join([*bodies, b""]), np.uint8), width)
                    word = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    hit = np.flatnonzero(bits[word >> 3] >> (word & 7).astype(np.uint8) & 1)
                    for i in hit:  # few: a piece's hash, or one in 2^BITMAP_BITS / pieces
                        here = int(i - first[owner[i]])
                        doc.append(ids[owner[i]])
                        seed.append(int(h[i].view(np.int64)))
                        at.append(here)
                        around.append(bodies[owner[i]][max(0, here - reach) : here + reach])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(seed, pa.int64()), pa.array(at, pa.int64()), pa.array(around, pa.binary())], names=["doc", "seed", "at", "around"])

    # a hit takes along the text around it, as far as the longest item may reach: no text is moved but this
    found = slim.mapInArrow(find, "doc long, seed long, at long, around binary")
    # where the item would begin; places within the budget of each other are verified as one
    size = F.octet_length("body")
    step = F.floor(F.col("size") / BYTES_AN_EDIT) + LEAST_EDITS
    hits = found.join(items.select("seed", "item", "offset", size.alias("size")), "seed")
    places = hits.groupBy("doc", "item", "size", F.floor((F.col("at") - F.col("offset")) / step).alias("place"), step.cast("long").alias("width")).agg(F.min(F.struct("at", "around")).alias("hit"))
    tasks = places.join(items.select("item", "body", size.alias("size")).distinct(), ["item", "size"]).select("doc", "item", "body", "place", "width", "hit.at", "hit.around")

    def verify(batches):
        for batch in batches:
            out = []
            for doc, item, body, place, width, at, around in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "body", "place", "width", "at", "around")), strict=True):
                k, from_ = budget(len(body)), max(0, at - reach)
                lo, hi = max(0, place * width - k), (place + 1) * width + len(body) + k
                edits, _ = distance(body, around[lo - from_ : max(0, hi - from_)], k)
                if edits <= k:
                    out.append((doc, item, edits, k, len(body)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "item", "edits", "budget", "size"])

    named = tasks.mapInArrow(verify, "doc long, item long, edits long, budget long, size long")
    best = named.groupBy("doc", "item").agg(F.min(F.struct("edits", "budget", "size")).alias("best"))
    return best.select(F.col("doc").alias(key), F.col("item").alias("item_id"), "best.edits", "best.budget", "best.size")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
