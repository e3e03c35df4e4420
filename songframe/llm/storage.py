"""Where intermediate tables and archives lie: the folder the cluster shares."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from songframe.session import checkpoint_root

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver's interpreter ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/songframe-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; the folder is then left to the cluster's sweep
            return


class Workspace:
    """Tables of one run. ``keep`` writes a frame and returns what reads it back, so that later
    steps, retried tasks and lost executors start from the files instead of from the whole plan."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = shared_folder(spark)
        self._n = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        # what was shuffled for the table is of no more use; Spark drops it once nothing refers to it
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"
