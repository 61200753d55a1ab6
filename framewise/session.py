"""Spark session settings shared by tests, bench and the entry point."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "framewise") -> SparkSession:
    """Return (or create) a session with the settings the operators assume.

    * UTC session time zone, so date arithmetic never depends on the host.
    * ANSI mode on (Spark 4 default): operators use ``try_divide`` where the
      modelled library turns a division by zero into NaN / 0.
    * AQE on with partition coalescing and skew-join splitting.
    * No UI server.
    """
    cpus = os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def compiled_methods(spark: SparkSession) -> None:
    """Spark's code for a stage with many columns can be one method of more
    than 8,000 bytes, which HotSpot never compiles; under this limit such a
    stage gets a method an expression instead."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > 8000:
        spark.conf.set(key, "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Only a local master may run without that setting (tests): a scratch
    folder is made then.  On a cluster a missing setting is an error, because
    a machine-local folder would not be seen by the other executors.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = conf or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="framewise-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: computed
    exactly once, and each pass reads the columns it needs."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
