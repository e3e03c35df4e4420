"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they can be applied to a session somebody else started.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A block row is about 1 MB. Batches for Python are bounded by bytes, and Parquet tables with
    # arrays are read row by row: a vectorised batch would hold 4,096 of their rows at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
    "spark.sql.parquet.compression.codec": "zstd",
    # Publishing replaces the partitions it writes; ``sinks.publish`` carries over their other recordings.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and return the same session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_songframe_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="songframe-"), "songframe.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._songframe_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by the driver and all executors.

    Where it is unset, a temporary folder is made if the session runs in the driver's own process,
    as in tests; with executors elsewhere this raises, since they would not see such a folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="songframe-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    context = df.sparkSession.sparkContext
    root = checkpoint_root(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows on ``keys`` over all shuffle partitions.

    For groups that are small in bytes but slow in Python: adaptive execution would put many of
    them into one task, and leaves an explicit number of partitions alone.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
