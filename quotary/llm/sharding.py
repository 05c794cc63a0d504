"""Jump consistent hashing (Lamping and Veach 2014) as Column expressions: no ring table, no lookup, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm.common import digest_bits, rank_within, table

#: The generator of the published algorithm: key -> key * MULTIPLIER + 1 mod 2^64.
MULTIPLIER, MODULUS = 2862933555777941757, 1 << 64
#: A row jumps ln(shards) + 0.6 times on average; over this many jumps have a chance below 1e-40 at 2^31 shards.
MOST_JUMPS = 128
SHARDS = 40


def jumps(key: Column, shards: int) -> Column:
    """Fold of the algorithm over a 64-bit integer key: struct<k, b, j>, the generator, the shard and the next jump."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    whole = key.cast("decimal(20,0)")
    unsigned = F.when(key < 0, (whole + F.lit(str(MODULUS)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(whole)
    start = F.struct(unsigned.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    modulus, multiplier = F.lit(str(MODULUS)).cast("decimal(20,0)"), F.lit(MULTIPLIER).cast("decimal(19,0)")

    def jump(state: Column, _: Column) -> Column:
        k = ((state["k"] * multiplier + F.lit(1)) % modulus).cast("decimal(20,0)")
        top = F.floor(k / F.lit(1 << 33).cast("decimal(11,0)")).cast("double") + F.lit(1.0)
        j = F.floor((state["j"].cast("double") + F.lit(1.0)) * (F.lit(float(1 << 31)) / top)).cast("long")
        return F.when(state["j"] >= shards, state).otherwise(F.struct(k.alias("k"), state["j"].alias("b"), j.alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, jump)


def with_shards(df: DataFrame, key: Column, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with each key's shard among `shards`, and among one more: the same jumps serve both counts, as with one shard
    more a row moves only if its next jump lands exactly on the new shard."""
    # explode of one element: a plan node of its own, so that the fold runs once a row and not once for each use
    state = df.withColumn("_state", F.explode(F.array(jumps(key, shards))))
    now = F.when(F.col("_state.j") >= shards, F.col("_state.b")).otherwise(F.raise_error(F.lit("a key jumped too often")).cast("long"))
    return state.withColumn(shard, now.cast("int")).withColumn(grown, F.when(F.col("_state.j") == shards, F.lit(shards)).otherwise(F.col(shard))).drop("_state")


def shard_rows(df: DataFrame, key: str, shards: int, *, shard: str = "shard", slot: str = "slot", grown: str = "grown_shard") -> DataFrame:
    """df with its shard, the shard it would have with one more, and its slot: a gapless rank from 0 within the shard.

    The key alone decides the shard: repeated keys go together, equal texts under other keys do not. A null key is
    treated as key 0. Columns of df that already carry one of the three names are replaced. Slots follow the digest of the
    key, then the key, then a hash of the whole row, so reruns agree; identical rows share a shard and take slots in
    any order among themselves. An empty table gives an empty result.
    """
    df = df.drop(shard, slot, grown)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    dealt = with_shards(df, F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), shards, shard, grown).withColumn("_h", digest_bits(digest))
    return rank_within(dealt, [shard], [F.col("_h"), F.col(key), F.xxhash64(*df.columns)], slot).drop("_h")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `key`. A null text has size 16 and a null checksum."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).cast("long").alias("text_crc32"),
    )
    return shard_rows(docs, "doc_id", SHARDS).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The checksum's table for four bits at a time.
NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]
OP1_SQL = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + {MODULUS} ELSE doc_id::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, n, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((n // 8589934592)::DOUBLE + 1)))::BIGINT FROM (SELECT *, (k * {MULTIPLIER}::HUGEINT + 1) % {MODULUS} AS n FROM k WHERE j < {SHARDS})
), s AS (
  SELECT doc_id, b AS shard, CASE WHEN j = {SHARDS} THEN j ELSE b END AS grown FROM k WHERE j >= {SHARDS}
), x AS (
  SELECT doc_id, octet_length(encode(text)) AS n, regexp_extract_all(hex(encode(text)), '.') AS x FROM documents
), c AS (
  SELECT doc_id, coalesce(n, 0) + 16 AS size, xor(list_reduce(list_transform(range(1, len(x) + 1), lambda i: (instr('0123456789ABCDEF', x[i + CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END]) - 1)::BIGINT),
    lambda c, v: xor({NIBBLES}[(xor(c, v) & 15) + 1], c >> 4), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32 FROM x
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM c JOIN s USING (doc_id)
"""
