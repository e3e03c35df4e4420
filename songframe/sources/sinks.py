"""Writing stage tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.session import checkpoint_root

# Recordings are hashed into this many folders, so that millions of recordings do not become
# millions of folders with one small file each.
SHARDS = 256


def with_shard(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("recording_id"), F.lit(shards)).cast("int"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _overwrite(table: DataFrame, path: str, by: str) -> None:
    (
        table.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(by)
        .parquet(path)
    )


def publish(df: DataFrame, path: str, by: str = "shard", shards: int = SHARDS) -> None:
    """Replace the recordings (or the partitions ``by``) that occur in ``df`` and keep all others.

    A shard holds many recordings, so the rows of its other recordings are read first. What the
    touched shards will hold is staged in the shared checkpoint folder, and takes their place only
    when it is complete. Rows are rebalanced on the partition column, which gives few files per folder
    and still splits a folder that is too large for one task.
    """
    spark = df.sparkSession
    if by != "shard":
        return _overwrite(df, path, by)
    table = with_shard(df, shards)
    if not exists(spark, path):
        return _overwrite(table, path, by)
    staged = f"{checkpoint_root(spark).rstrip('/')}/publish-{uuid.uuid4().hex}"
    table.write.parquet(f"{staged}/new")
    new = spark.read.parquet(f"{staged}/new")
    old = spark.read.parquet(path)
    touched = F.broadcast(new.select("shard").distinct())  # at most ``shards`` numbers
    kept = old.join(touched, "shard", "left_semi").join(new.select("recording_id").distinct(), "recording_id", "left_anti")
    kept.unionByName(new, allowMissingColumns=True).write.parquet(f"{staged}/merged")
    _overwrite(spark.read.parquet(f"{staged}/merged"), path, by)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose ``keys`` the table does not hold yet, so a repeated batch adds nothing.

    Only the batch's recordings are looked up in what is there.
    """
    spark = df.sparkSession
    if exists(spark, path):
        ids = df.select("recording_id").distinct()
        known = spark.read.parquet(path).join(ids, "recording_id", "left_semi").select(*keys).distinct()
        df = df.join(known, keys, "left_anti")
    df.write.mode("append").option("compression", "zstd").parquet(path)


def append_hypothesis(df: DataFrame, path: str) -> None:
    """Add hypotheses beside the existing ones.

    Folders are by kind, the part of the id before a colon: there may be a hypothesis per
    correction, and a folder each would be too many.
    """
    (
        df.withColumn("hypothesis_kind", F.substring_index("hypothesis_id", ":", 1))
        .write.mode("append")
        .option("compression", "zstd")
        .partitionBy("hypothesis_kind")
        .parquet(path)
    )


def save_blocks(blocks: DataFrame, table: str, buckets: int) -> None:
    """Store waveform blocks bucketed on the key that the mixture and its stems are joined on.

    Later joins of tracks on (recording, block) then need no shuffle. Each bucket is one file.
    """
    (
        blocks.repartition(buckets, "recording_id", "block_index")
        .write.mode("overwrite")
        .bucketBy(buckets, "recording_id", "block_index")
        .sortBy("recording_id", "block_index")
        .option("compression", "zstd")
        .saveAsTable(table)
    )


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet done: rows whose key, configuration and parent are not in the output."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
