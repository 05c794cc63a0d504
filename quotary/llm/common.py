"""What the operators of this subpackage share: table access, lineage cuts, two-level ranks and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that removes a query's shuffle files at its end, not when the driver's garbage collection finds them.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("quotary.scratch.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("quotary.scratch.dir", named)
    return named


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back.

    A lost executor then costs a task's reread, not a recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quotary-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANS, "false")
    spark.conf.set(CLEANS, "true")  # what was shuffled for the table goes as soon as it's written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANS, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._quotary_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize wrote and from which nothing is left to be computed: whatever came from them is written itself."""
    for df in tables:
        path = getattr(df, "_quotary_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null. What remains between blanks is counted by removing every word but its first character."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_bits(digest: Column) -> Column:
    """A hex digest's first 60 bits as a 64-bit integer spread over all values, in the order of the digests."""
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)") * 16 - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def rank_within(df: DataFrame, group: list[str], order: list[Column], out: str, buckets: int = 64) -> DataFrame:
    """Gapless rank from 0 within each group, without one task holding a group.

    `order` starts with an integer column that is spread evenly over all 64-bit values (a hash): its top bits deal a
    group into `buckets` ranges. A range is ranked by its own window task and shifted by the rows in the ranges before
    it; the shifts are a table of groups x buckets rows.
    """
    df = df.withColumn("_b", range_bucket(order[0], buckets))
    counts = df.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_sb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy(*group, "_b").orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(own) - 1)
    same = F.col("_b") == F.col("_sb")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(shifts, same).withColumn(out, (F.col("_r") + F.col("_shift")).cast("long")).drop("_b", "_sb", "_r", "_shift", *[f"_g{i}" for i in range(len(group))])


def range_bucket(hash64: Column, buckets: int) -> Column:
    """The range, of `buckets` equal ones, in which a 64-bit value falls; order is kept."""
    bits = (buckets - 1).bit_length()
    return (F.shiftright(hash64, 64 - bits) + F.lit(1 << (bits - 1))).cast("int")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node id reachable over `edges`, for every node that has an edge.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): each is one grouped minimum, combined before
    its shuffle, and one equi-join that adaptive execution may split, so a hub with millions of links isn't one task's
    work. It ends when all links point straight at the smallest node, after a number of rounds that is logarithmic in
    the longest path.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialize(links, "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nearer = materialize(small.where("u <> v").distinct(), "links")
        discard(links)
        links = nearer
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node points at one node at most, and none that is pointed at points on."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("to")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("to")))
    return roles.groupBy("node").agg(F.sum("out").alias("out"), F.max("to").alias("to")).where("out > 1 or (out > 0 and to > 0)").isEmpty()
