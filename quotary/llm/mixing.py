"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotary.llm.common import digest_bits, materialize, n_words, range_bucket, table

#: Words in a block. A source's takings differ from its target by less than one word, whatever the block.
BLOCK = 64
#: No document is taken more often than this.
MOST_EPOCHS = 3
#: 2^32 / golden ratio: slot n lies at (n * STEP mod 2^32) / 2^32, the golden-ratio sequence in whole numbers.
STEP, CIRCLE = 2654435769, 1 << 32
#: The unit circle is cut into so many arcs, the equi-key by which slots find their source.
ARCS = 1024
#: Slots in a run, and ranges of a source: what one window task ranks.
RUN, RANGES = 4096, 256


def targets(sizes: DataFrame, source: str = "source", most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) for every source of `sizes(source, size)`.

    Sources by code point, null last, weigh 1, 2, 3, repeating. All sizes are shared by weight; a target stops at `most`
    times its source's size and the excess is reshared. In closed form: by ascending most * size / weight, the first so
    many sources are full, and the rest share what is left by weight. The windows run over one row a source.
    """
    total = sizes.groupBy(source).agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    weighed = total.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))
    fill = Window.orderBy((most * F.col("source_size") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = (
        weighed.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    share = F.col("weight") * (F.col("_all") - F.col("_full")) / F.col("_w")
    # in this order, the first source that isn't full fixes the level for all that follow
    level = F.first(F.when(share <= most * F.col("source_size"), (F.col("_all") - F.col("_full")) / F.col("_w")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    full = (most * F.col("source_size")).cast("double")
    return left.withColumn("_level", level).select(source, "source_size", "weight", F.when(F.col("_level").isNull(), full).otherwise(F.least(full, F.col("weight") * F.col("_level"))).alias("target"))


def schedule(spark: SparkSession, quotas: DataFrame) -> DataFrame:
    """(slot, source_no, turn): which source each slot of the mix draws from, and the how-manieth time.

    `quotas(source_no, slots)`. Slot n is the n-th golden-ratio point; it belongs to the source whose arc of the
    cumulative quotas holds the point, so every stretch of the schedule has the target mixture. A source stops at its
    quota; the few turns that the points leave it short of are appended after the last slot.
    """
    q = quotas.where("slots > 0")
    order = Window.orderBy("source_no")
    arcs = q.withColumn("_to", F.sum("slots").over(order)).withColumn("_all", F.sum("slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda x: F.floor(x * F.lit(float(CIRCLE)) / F.col("_all")).cast("long")
    arcs = arcs.select("source_no", "slots", at(F.col("_to") - F.col("slots")).alias("lo"), at(F.col("_to")).alias("hi"))
    width = CIRCLE // ARCS
    arcs = arcs.where("lo < hi").withColumn("arc", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    n = q.agg(F.sum("slots")).first()[0] or 0
    points = spark.range(n).withColumn("point", F.expr(f"cast(pmod(cast(pmod(id, {CIRCLE}) as decimal(20,0)) * {STEP}, cast({CIRCLE} as decimal(20,0))) as long)"))
    dealt = points.withColumn("arc", F.floor(F.col("point") / width)).join(arcs, "arc").where("point >= lo and point < hi").select(F.col("id").alias("slot"), "source_no", "slots")
    # turns: the rank of a slot among its source's, by runs of slots
    dealt = dealt.withColumn("run", F.floor(F.col("slot") / RUN))
    counts = dealt.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    shift = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1).join(counts.select("source_no", "run", shift.alias("_s")), ["source_no", "run"])
    turns = turns.select("slot", "source_no", (F.col("_r") + F.col("_s")).cast("long").alias("turn"), "slots").where("turn < slots").drop("slots")
    had = turns.groupBy("source_no").agg(F.count(F.lit(1)).alias("had"))
    short = q.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    late = short.select(F.lit(n).cast("long").alias("slot"), "source_no", F.explode(F.sequence(F.col("had").cast("long"), F.col("slots") - 1)).alias("turn"))
    return turns.unionByName(late)


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, most: int = MOST_EPOCHS) -> DataFrame:
    """Every row of docs with size, source_size, target, taken and first_slot.

    A source's documents are laid end to end in the order of md5(key), then key, then text, and cut into blocks of `block` words.
    The schedule's turns take its blocks in that order, again from the start after the last; the last turn stops at the
    target, so a source's takings are its target without the fraction of a word. A document takes its part of each taken
    block: at most `most` times its size. Null and empty texts have size 0 and take 0; rows with a null source form one
    source; repeated rows are documents of their own; an empty table gives an empty result. Columns of docs that carry a
    name of the result are replaced. Reruns agree, as no order depends on the partitioning.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "taken", "first_slot") if c not in (key, text, source)])
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"), digest.alias("_d"), F.xxhash64(*docs.columns).alias("_x"), F.octet_length(text).alias("_bytes"))
    slim = materialize(slim.withColumn("_h", digest_bits(F.col("_d"))), "mix-sizes")
    goal = targets(slim.select(F.col("_source").alias("source"), "size"))
    goal = goal.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    blocks = F.ceil(F.col("source_size") / block)
    whole = F.floor("target")
    goal = goal.withColumn("words", whole.cast("long")).withColumn("blocks", blocks.cast("long"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("slots", (rounds * F.col("blocks") + F.ceil((F.col("words") - rounds * F.col("source_size")) / block)).cast("long"))
    goal = materialize(goal, "mix-goals")

    # a turn's block, and how far into the block it goes
    turns = schedule(spark, goal.select("source_no", "slots")).join(goal.select("source_no", "source_size", "words", "blocks"), "source_no")
    turns = turns.withColumn("block", F.col("turn") % F.col("blocks"))
    at = F.floor(F.col("turn") / F.col("blocks")) * F.col("source_size") + F.col("block") * block
    turns = turns.withColumn("depth", F.least(F.lit(block).cast("long"), F.col("words") - at))
    # takings of a block: its full turns, and the depth of the one turn that the target cuts
    takes = turns.groupBy("source_no", "block").agg(
        F.sum(F.when(F.col("depth") >= block, 1).otherwise(0)).alias("full"),
        F.max(F.when(F.col("depth") < block, F.col("depth")).otherwise(0)).alias("part"),
        F.min("slot").alias("slot"),
    )

    # each document's place in its source's stream: ranges of the hash, then a sum within the range
    placed = slim.join(goal.select(F.col("source").alias("_goal_source"), "source_no", "source_size", "target"), F.col("_source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    placed = placed.withColumn("_b", range_bucket(F.col("_h"), RANGES))
    sums = placed.groupBy("source_no", "_b").agg(F.sum("size").alias("_n"))
    shift = F.coalesce(F.sum("_n").over(Window.partitionBy("source_no").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    own = Window.partitionBy("source_no", "_b").orderBy("_h", "_d", "_key", "_bytes", "_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_r", F.coalesce(F.sum("size").over(own), F.lit(0))).join(sums.select("source_no", "_b", shift.alias("_s")), ["source_no", "_b"])
    placed = materialize(placed.withColumn("start", F.col("_r") + F.col("_s")).withColumn("_row", F.monotonically_increasing_id()).drop("_r", "_s", "_b"), "mix-places")

    parts = placed.where("size > 0").select("_row", "source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block) - F.col("block") * block
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block
    got = parts.join(takes, ["source_no", "block"]).groupBy("_row").agg(
        F.sum((hi - lo) * F.col("full") + F.greatest(F.lit(0), F.least(hi, F.col("part")) - lo)).alias("taken"),
        F.min("slot").alias("first_slot"),
    )
    return placed.join(got, "_row", "left").select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with production parameters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), f AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM w
), l AS (
  SELECT arg_min((total - filled) / open_weight, (3 * source_size / weight, source IS NULL, source)) FILTER (WHERE weight * (total - filled) / open_weight <= 3 * source_size) AS level FROM f
), t AS (
  SELECT f.source, source_size, CASE WHEN level IS NULL THEN 3.0 * source_size ELSE least((3 * source_size)::DOUBLE, weight * level) END::DOUBLE AS target FROM f, l
), g AS (
  SELECT *, floor(target)::BIGINT AS words, ((source_size + 63) // 64)::BIGINT AS blocks, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM t
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * blocks + (CASE WHEN source_size > 0 THEN words % source_size ELSE words END + 63) // 64 AS slots FROM g
), q AS (
  SELECT *, (sum(slots) OVER (ORDER BY source_no))::BIGINT AS upto, (sum(slots) OVER ())::BIGINT AS every FROM u WHERE slots > 0
), a AS (
  SELECT *, floor((upto - slots) * 4294967296.0::DOUBLE / every)::BIGINT AS lo, floor(upto * 4294967296.0::DOUBLE / every)::BIGINT AS hi FROM q
), n AS (
  SELECT i AS slot, (i::HUGEINT * 2654435769 % 4294967296)::BIGINT AS point FROM range((SELECT coalesce(sum(slots), 0)::BIGINT FROM u)) x(i)
), r AS (
  SELECT slot, source_no, slots, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS turn FROM n JOIN a ON point >= lo AND point < hi
), z AS (
  SELECT slot, source_no, turn FROM r WHERE turn < slots
  UNION ALL
  SELECT every, source_no, unnest(range(had, slots)) FROM (SELECT q.source_no, slots, every, coalesce((SELECT count(*) FROM r WHERE r.source_no = q.source_no AND turn < r.slots), 0) AS had FROM q)
), k AS (
  SELECT z.source_no, turn % blocks AS block, min(slot) AS slot FROM z JOIN u USING (source_no) GROUP BY ALL
), p AS (
  SELECT doc_id, size, h, t.source_no, source_size, target, t.source,
    coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds
  FROM d JOIN g t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, floor(target)::BIGINT - rounds * source_size - start)))::BIGINT AS taken, source, first_slot
FROM p LEFT JOIN (
  SELECT p.doc_id AS _doc, min(k.slot)::BIGINT AS first_slot FROM p JOIN k ON k.source_no = p.source_no AND p.size > 0 AND k.block BETWEEN start // 64 AND (start + size - 1) // 64 GROUP BY ALL
) ON doc_id = _doc
"""
