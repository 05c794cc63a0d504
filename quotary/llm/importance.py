"""Importance resampling towards a target distribution, by hashed word n-grams (Xie et al. 2023).

Features of a text are its words and pairs of adjoining words; a feature's bucket is the CRC of its bytes. The vocabulary
has a head and a tail. For frequent words every task gets the exact CRC, and for pairs of the most frequent ones the exact
bucket; a word of the tail takes the CRC of its bytes, and a pair with one goes on from the CRC of its first word over the
second, which is a linear map of 32 bits for each length. Which words are in the head changes the speed and no result: all
come to exact totals by bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.llm.common import materialize, table

BUCKETS = 10000
#: The part of the candidates that is drawn, in percent, the words that a candidate has at least, and the seed of the draw.
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Frequent words that are broadcast with their CRC (a megabyte), and those whose pairs are broadcast with their buckets (2 MB).
HEAD, PAIRED = 16384, 1024
#: Documents, chosen by hash, in which frequent words are looked for; each counts its words whole.
LOOKED_AT = 2000
#: Bytes of text that are read at a time, and the length to which words of the head and of the linear maps go.
PIECE, LONG = 1 << 22, 48
#: Fixed value: the reversed polynomial of the CRC.
POLYNOMIAL = 0xEDB88320
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Of lower-cased bytes, those of words: digits, letters and all of code points beyond ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _step_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_STEP = _step_table()


def _shift_tables() -> np.ndarray:
    """[length, byte place, byte value]: what a CRC's byte becomes when `length` more bytes follow. A CRC is linear, so
    crc(a + b) = the exclusive or of crc(b) and the four entries of crc(a) at b's length."""
    out = np.zeros((LONG + 1, 4, 256), np.uint32)
    for place in range(4):
        state = (np.arange(256, dtype=np.uint64) << np.uint64(8 * place)).astype(np.uint32)
        for n in range(LONG + 1):
            out[n, place] = state
            state = _STEP[state & 255] ^ (state >> 8)
    return out


_SHIFT = _shift_tables()


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of a + b from the CRCs of both and the length of b, at most LONG."""
    out = second.copy()
    for place in range(4):
        out ^= _SHIFT[length, place, (first >> np.uint32(8 * place)) & 255]
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """CRC after one space more."""
    state = ~crc
    return ~(_STEP[(state ^ 32) & 255] ^ (state >> 8))


class Head:
    """The frequent words, most frequent first, with their CRCs and the buckets of pairs of the first ones."""

    def __init__(self, words: list[bytes], buckets: int):
        self.words, self.buckets = pa.array(words, pa.binary()), buckets
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        lengths, n = np.array([len(w) for w in words], np.int64)[:PAIRED], min(len(words), PAIRED)
        first, second = np.repeat(_spaced(self.crc[:n]), n), np.tile(self.crc[:n], n)
        self.pairs = (_joined(first, second, np.tile(lengths, n)) % buckets).astype(np.int32).reshape(n, n)


def pieces(texts: list[bytes | None], piece: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start of each part, text of each part, whether its first word was read before): lower-cased texts one after another, of `piece` bytes or little more.

    A longer text is cut between words into parts; each begins with the last word of the one before, for the pair across the cut.
    """
    held, size, starts, owners, again = [], 0, [], [], []

    def out():
        return b" ".join(held), np.array(starts, np.int64), np.array(owners, np.int64), np.array(again, bool)

    for i, text in enumerate(texts):
        lower, at, end, repeats = (text or b"").translate(_LOWER), 0, -1, False
        while True:
            end = _after_word(lower, max(at + piece, end + 1)) if len(lower) - at > piece else len(lower)
            starts.append(size), owners.append(i), again.append(repeats), held.append(lower[at:end])
            size += end - at + 1
            if size > piece:
                yield out()
                held, size, starts, owners, again = [], 0, [], [], []
            if end == len(lower):
                break
            at, repeats = _last_word(lower, at, end)
    if held:
        yield out()


def _after_word(b: bytes, at: int) -> int:
    while at < len(b):
        stops = np.flatnonzero(~_IN_WORD[np.frombuffer(b, np.uint8, min(4096, len(b) - at), at)])
        if len(stops):
            return at + int(stops[0])
        at += 4096
    return len(b)


def _last_word(b: bytes, at: int, end: int) -> tuple[int, bool]:
    """Where the last word of b[at:end] begins, and whether there is one."""
    inside = _IN_WORD[np.frombuffer(b, np.uint8, end - at, at)]
    found = np.flatnonzero(inside)
    if not len(found):
        return end, False
    before = np.flatnonzero(~inside[: found[-1]])
    return at + (int(before[-1]) + 1 if len(before) else 0), True


def features(joined: bytes, starts: np.ndarray, again: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its part, whether it's a word) of the parts' words and pairs."""
    raw = np.frombuffer(joined, np.uint8)
    inside = _IN_WORD[raw]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    length, part = end - begin, np.searchsorted(starts, begin, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    place = pc.fill_null(pc.index_in(words, value_set=head.words), -1).to_numpy(zero_copy_only=False)
    crc = np.empty(len(length), np.uint32)
    known = place >= 0
    crc[known] = head.crc[place[known]]
    crc[~known] = [zlib.crc32(w) for w in words.filter(pa.array(~known)).to_pylist()]
    left = np.flatnonzero(part[1:] == part[:-1])  # a pair's first word
    right = left + 1
    pairs = np.empty(len(left), np.int64)
    paired = (place >= 0) & (place < len(head.pairs))
    frequent = paired[left] & paired[right]
    pairs[frequent] = head.pairs[place[left[frequent]], place[right[frequent]]]
    rest = ~frequent & (length[right] <= LONG)
    pairs[rest] = _joined(_spaced(crc[left[rest]]), crc[right[rest]], length[right[rest]]) % head.buckets
    for i in np.flatnonzero(~frequent & ~rest):  # words too long for the maps
        pairs[i] = zlib.crc32(b" " + joined[begin[right[i]] : end[right[i]]], int(crc[left[i]])) % head.buckets
    first = np.concatenate([[True], part[1:] != part[:-1]])
    new = ~(first & again[part])
    return np.concatenate([(crc % head.buckets)[new], pairs]), np.concatenate([part[new], part[left]]), np.concatenate([np.ones(int(new.sum()), bool), np.zeros(len(left), bool)])


def frequent_words(docs: DataFrame, text: str, most: int) -> list[bytes]:
    """The most frequent words of LOOKED_AT texts that a hash chooses, `most` at most, most frequent first."""
    word = F.explode(F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(max(1, n // LOOKED_AT))) == 0)
    counts = some.select(word.alias("w")).where(F.octet_length("w") <= LONG).groupBy("w").count()
    return [r["w"].encode() for r in counts.orderBy(F.desc("count"), "w").limit(most).collect()]


def bucket_totals(texts: DataFrame, text: str, head: Head) -> np.ndarray:
    """Features by bucket over all rows: each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.buckets, np.int64)
        for batch in batches:
            for joined, starts, _, again in pieces(batch.column(0).to_pylist()):
                total += np.bincount(features(joined, starts, again, head)[0], minlength=head.buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.encode(text, "UTF-8").alias("t")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(head.buckets, np.int64)
    for r in rows:  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target's share over source's share) by bucket, both with one feature more in each bucket."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel variate, from a digest of the seed and the key: the highest sums of weight and noise
    are a draw without replacement, in proportion to the weights."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score), a row a row of docs: weight is the floored mean gain of its features."""
    head = Head(frequent_words(docs, text, HEAD), buckets)
    gain = gains(bucket_totals(docs, text, head), bucket_totals(target, target_text, head))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for joined, starts, owners, again in pieces(batch.column(1).to_pylist()):
                bucket, part, is_word = features(joined, starts, again, head)
                owner = owners[part]
                words += np.bincount(owner[is_word], minlength=n)
                count += np.bincount(owner, minlength=n)
                np.add.at(total, owner, gain[bucket])
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, count, weight)]], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.encode(text, "UTF-8").alias("t")).mapInArrow(scored, f"key {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank), a row a row of docs. rank counts from 1, by score and then the smaller key,
    over the floor of `percent` % of the rows with at least `least_words` words; other rows have a null rank.

    Null texts have no features and weight 0, as have texts without words; an empty target gives gains against one
    feature a bucket. A null key is an empty string in the draw's digest and comes first among ties. Rows that repeat a
    key share its noise, are each a candidate, and take ranks in any order where texts are equal too. Other columns
    aren't read. An empty table gives an empty result.
    """
    rows = materialize(weigh(docs, target, key=key, text=text, target_text=target_text, buckets=buckets, seed=seed), "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    # ranges of the order, of about equal size; their numbers are written with the rows, so a rerun can't change them
    order = [F.col("score").desc(), F.col(key).asc_nulls_first()]
    parts = max(1, -(-rows.count() // 100_000))
    dealt = materialize(able.repartitionByRange(max(parts, able.sparkSession.sparkContext.defaultParallelism), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "n_features", "weight"))
    ranked = dealt.withColumn("_r", within).join(F.broadcast(shifts), "_part").withColumn("_rank", (F.col("_r") + F.col("_shift")).cast("long"))
    drawn = ranked.select(key, "n_features", "weight", "score", F.when(F.col("_rank") <= most, F.col("_rank")).alias("rank"))
    return drawn.unionByName(rows.where(F.col("n_words") < least_words).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents of 20 words or more, drawn towards the distribution of the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text"))



#: The checksum's table for four bits at a time.
NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def crc_sql(text: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a text's UTF-8."""
    half = "(instr('0123456789ABCDEF', x[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END]) - 1)::BIGINT"
    return f"""xor(list_reduce(list_transform([regexp_extract_all(hex(encode({text})), '.')], lambda x: list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1), lambda i: {half})),
      lambda c, v: xor({NIBBLES}[(xor(c, v) & 15) + 1], c >> 4))), lambda a, b: a), 4294967295)::BIGINT"""


#: Words of a lower-cased text, for RE2.
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def features_sql(table_: str, id_: str) -> str:
    words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
    return f"""SELECT {id_}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT {id_}, {words} AS w FROM {table_} WHERE text IS NOT NULL)"""


OP13_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')), 0) AS n_words FROM documents),
df AS (SELECT doc_id, f, count(*) AS n FROM ({features_sql('documents', 'doc_id')}) GROUP BY doc_id, f),
tf AS (SELECT f, count(*) AS n FROM ({features_sql('benchmark', 'item_id')}) GROUP BY f),
b AS (SELECT f, {crc_sql('f')} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM tf)),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN b USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM tf JOIN b USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (tot.s + {BUCKETS})) / ((s.n + 1)::DOUBLE * (tot.t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
d AS (SELECT doc_id, sum(df.n)::BIGINT AS n_features, sum(df.n * gain)::BIGINT AS total FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END::BIGINT AS weight,
  ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (doc_id)),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score, n_words >= {LEAST_WORDS} AS able FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= n * {PERCENT} // 100 THEN r END::BIGINT AS rank FROM r
"""
