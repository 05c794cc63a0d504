"""Scans and sinks: tables by name, JSON Lines with malformed lines dropped, nested collections, whole texts, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with a declared schema: lines that aren't records of it are dropped, fields that are missing are null. Strings may be
    as long as Spark's own; the reader's default would drop lines with longer ones than 20 million characters."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("maxStringLen", (1 << 31) - 1).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """One line per row, added to what is there."""
    df.write.mode("append").json(path)


def nested_canon(spark: SparkSession, path: str) -> DataFrame:
    """Groups with embedded passages, from JSON files of whole documents, as one row a passage."""
    schema = "id int, name string, transliteration string, verses array<struct<id:int,text:string>>"
    groups = spark.read.schema(schema).option("multiLine", True).json(path)
    return groups.select(F.col("id").alias("group_id"), "name", F.explode("verses").alias("v")).select("group_id", "name", F.col("v.id").alias("passage_id"), "v.text")


def collections(spark: SparkSession, path: str, known: list[str], least_words: int = 5) -> DataFrame:
    """Passages of the collection files whose name is known; passages of too few words are left out."""
    rows = spark.read.schema("number string, text string").json(path).withColumn("collection", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.where(F.col("collection").isin(known) & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_words))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text, its ends trimmed."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))


def word_manifests(spark: SparkSession, path: str, words: str = "words", multi_line: bool = True) -> DataFrame:
    """(path, block, pos, word, start, end): S9. The word times of manifests, JSON objects {blocks: [{i, words: [[word, start, end], ..]}]}, one a file
    or, without `multi_line`, one a line. Blocks without words, files that aren't such objects and words without a start give no row; only the columns
    that are asked for are parsed."""
    schema = f"blocks array<struct<i:bigint,{words}:array<array<string>>>>"
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)
    block = read.select(F.input_file_name().alias("path"), F.explode("blocks").alias("b")).select("path", F.col("b.i").alias("block"), F.posexplode(F.col(f"b.{words}")).alias("pos", "w"))
    number = lambda i: F.get("w", F.lit(i)).try_cast("double")
    return block.select("path", "block", F.col("pos").cast("long").alias("pos"), F.get("w", F.lit(0)).alias("word"), number(1).alias("start"), number(2).alias("end")).where("start is not null")


def reader_blocks(spark: SparkSession, path: str, script: str = r"[\u0600-\u06FF]", mark: str = "\u2500{20,}", header: str = r"(?i)^ANNOTATED READER VIEW\s*=+\s*", share: float = 0.4, lines: bool = False) -> DataFrame:
    """(path, block, script, other): S6. The blocks of readers, texts cut at lines of marks: the paragraphs of which more than `share` of the characters but
    white space are of the script, joined by a blank, and the others, by an empty line. Blocks that lack either are left out and
    don't count; `block` counts from 0. A file is a reader; with `lines` files are JSON Lines of {path, text}, a reader each, so that
    many readers need no file each."""
    read = json_lines(spark, path, "path string, text string") if lines else spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    whole = read.select("path", F.posexplode(F.split("text", mark)).alias("_i", "_b"))
    paras = F.filter(F.transform(F.split(F.trim(F.regexp_replace(_bare(F.col("_b")), header, "")), r"\n\n+"), _bare), lambda p: p != "")
    size = lambda p: F.length(F.regexp_replace(p, r"\s", ""))
    of = lambda p: F.regexp_count(p, F.lit(script)) > share * size(p)
    two = whole.select("path", "_i", F.explode(F.array(paras)).alias("p")).select("path", "_i", F.array_join(F.filter("p", of), " ").alias("script"), F.array_join(F.filter("p", lambda p: ~of(p)), "\n\n").alias("other"))
    order = Window.partitionBy("path").orderBy("_i")
    return two.where("script <> '' and other <> ''").select("path", (F.row_number().over(order) - 1).cast("long").alias("block"), "script", "other")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def write_results(df: DataFrame, path: str, run: str = "run") -> None:
    """Nested results, one folder a run."""
    df.write.mode("overwrite").partitionBy(run).parquet(path)


def when_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """target, or seed if target has no row."""
    return target.unionByName(seed.join(target.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti"))
