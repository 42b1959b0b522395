"""Reading the given Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the session's shared folder. The folder is the one named in ``spark.checkpoint.dir``; only where
    none is named, as in tests, a temporary one is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-privatrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write a table that several steps read to the session's shared folder, once, and read it from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def append_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Append to a log that is bucketed and sorted by ``key``, and return the log. Logs of one key and number of buckets
    meet, and give their latest rows, without a shuffle. Rows move once here, so that a bucket gets one file a call.
    ``path`` places a new table outside the warehouse."""
    writer = df.repartition(buckets, key).write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan that has fewer splits than the cluster has cores.

    Scanning text is CPU-bound, so a small table in few row groups is worth one shuffle. A
    large table has more splits than cores and is left as it is.
    """
    parallelism = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() >= 4 * parallelism:
        return scan
    return scan.repartition(2 * parallelism)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, text, page, size_bytes): one row per file, decoded as UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path"),
        F.decode("content", "UTF-8").alias("text"),
        F.lit(1).alias("page"),
        F.col("length").alias("size_bytes"),
    )
