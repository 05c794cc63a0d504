"""Tables written to cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset a folder of our own serves local runs;
    on a cluster it's an error, as executors don't share a machine's folders."""
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

    A lost executor then costs a task's reread, not a recomputation of everything before; and the planner knows its size.
    """
    path = f"{shared_dir(df.sparkSession)}/quotary-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
