"""From raw documents to training shards: quality, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotary.llm import decontaminate, mixing, ngram_join, quality, sharding
from quotary.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows score as op3 has it, nulls as empty texts; repeated rows stay or go together. An empty table stays empty.
    """
    nets = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "_quality_score"
    return quality.with_score(docs, nets, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 on five-word shingles one stays: the smallest
    doc_id, which names the group.

    Texts without words link with nothing and stay. Rows that share a doc_id and stay are repeats of one document: of these one stays. Rows with a
    null doc_id can't be linked and stay.
    """
    groups = ngram_join.similar_components(docs, n=5, num=4, den=5)
    chosen = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_chosen")).distinct()
    named = docs.where("doc_id is not null").join(chosen, F.col("doc_id") == F.col("_chosen"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands, within its budget of edits, go.

    Null texts hold no item and stay, as do rows with a null doc_id; an empty benchmark keeps all.
    """
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col("_leak"), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document that the schedule takes, in part or whole, is there as often as it was begun, 3 times
    at most; one that it doesn't take goes. Texts without words take nothing and go.

    Repeated rows of one doc_id are mixed as documents of their own and count together.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source"))
    times = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int")))
    return docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id"))).where(mixing.n_words(F.col("text")) > 0).withColumn("_copy", copies).select(*docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the columns of documents and their shard, slot and the shard they would have with one more.

    Repeats of a document share its shard, as its key decides, and have slots of their own.
    """
    return sharding.shard_rows(docs, "doc_id", sharding.SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("mixture", mix_sources),
    ("shards", to_shards),
]
#: SQL can't express the network's scores: the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
