"""Files from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.storage import freeing_shuffles

SPREAD_BYTES = 256 * 1024 * 1024


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small table over all cores before heavy per-row work.

    A Parquet row group is read by one task, so a table of a few row groups keeps most
    cores idle. Only tables below ``SPREAD_BYTES`` by the planner's size estimate are
    moved; larger ones keep their scan partitions, as shuffling contents would cost
    more than it gains.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def files_from_text(df: DataFrame, repo_id: Column, path: Column, text: Column) -> DataFrame:
    """Text rows as ``files``."""
    content = F.encode(text, "UTF-8")
    return df.select(
        repo_id.cast("string").alias("repo_id"),
        path.alias("path"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.lit(False).alias("is_symlink"),
        content.alias("content"),
    )


def store_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files`` to a table in which those that steer a scan (the ignore lists) are a
    partition of their own, ``control``, and read it back. A scan then looks for them there,
    and reads the contents of all others once. Files without a path are not ``control``."""
    control = F.coalesce(F.col("path") == rules.IGNORE_FILE, F.lit(False))
    with freeing_shuffles(files.sparkSession):
        files.withColumn("control", control).write.partitionBy("control").parquet(folder)
    return read_files(files.sparkSession, folder, files)


def read_files(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A table of ``store_files``, with the columns of ``like`` and ``control``."""
    columns = like.withColumn("control", F.lit(False))
    return spark.read.schema(columns.schema).parquet(folder)
