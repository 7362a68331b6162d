"""The folder that driver and executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


ARROW_KEY, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES at most, unless the session has a bound of its own: so what a task holds of long texts or large blocks has a bound in
    the JVM as in Python. Spark has this as a setting of the session alone, so it stays set."""
    if spark.conf.get(ARROW_KEY, None) is None:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))


def dealt(rows: DataFrame, most: int, *key: str | Column) -> DataFrame:
    """rows dealt out by key to tasks of about `most` rows, however few files or bytes they have: for steps that make much of a row.
    Counts the rows, so they should be cheap to read."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / most)), *key)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only in local mode, where it may be unset, a temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rasterlane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rasterlane-{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """df written as a Parquet table in the shared folder and read again: survives lost executors, and holds row numbers and
    the like still. Returns the table and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
