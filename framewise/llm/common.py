"""Helpers shared by the corpus operators: staged tables and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage,
    survives lost executors and is computed exactly once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows to Python at once: the session's default
    suits numbers, ten thousand whole texts would fill a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (NULL text as empty), whatever else the
    table carries; they go to Python in :func:`text_batches`."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partition count that keeps ``per_partition`` rows a task, at least the
    session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition), 1)
