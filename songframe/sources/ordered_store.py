"""Tables stored in the order of a key and a position, and read by the ranges that are asked for."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, POSITION = "recording_id", "start_sample"
# Row groups of block tables are cut at about this size, so that a read skips most of a file.
ROW_GROUP_BYTES = 16 << 20


def save_ordered(df: DataFrame, path: str, files: int, length: str = "length") -> OrderedTable:
    """Write ``df`` sorted by recording and position, and what the reader has to know about it.

    Spark samples the keys and deals the rows out in ranges, so a file holds neighbouring recordings
    and a recording with very many rows is spread over several. Beside the rows lies one row per file
    with its first and last key, the order, and the largest ``length`` of a row (its extent from its
    position on). A table that is written again is replaced. Null keys come first.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(files, KEY, POSITION).sortWithinPartitions(KEY, POSITION)
    ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{path}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{path}/rows")
    at = F.struct(KEY, POSITION)
    ranges = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max(length).cast("bigint").alias("extent"), F.count(F.lit(1)).alias("rows")
    )
    ranges.withColumn("order", F.array(F.lit(KEY), F.lit(POSITION))).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    return OrderedTable(spark, path)


@dataclass
class OrderedTable:
    spark: SparkSession
    path: str

    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def files_for(self, requests: DataFrame, start: str, end: str) -> list[str]:
        """The files whose keys meet a requested range [start, end) of a recording.

        First and last keys of all files, one row each, go to the tasks, which look requests up by
        bisection; what comes back is at most the list of files.
        """
        known = sorted((tuple(r["first"]), tuple(r["last"]), r.file) for r in self.ranges().filter(F.col("first.recording_id").isNotNull()).collect())
        extent = self.extent()
        firsts, lasts = [k[0] for k in known], [k[1] for k in known]

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: set[int] = set()
            for batch in batches:
                for key, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    begin = bisect.bisect_left(lasts, (key, low - extent + 1))
                    found.update(range(begin, bisect.bisect_left(firsts, (key, high))))
            yield pa.RecordBatch.from_pydict({"file": pa.array(sorted(found), pa.int32())})

        asked = requests.filter(F.col(KEY).isNotNull() & (F.col(end) > F.col(start))).select(KEY, F.col(start).cast("bigint"), F.col(end).cast("bigint"))
        return [known[r.file][2] for r in asked.mapInArrow(touched, "file int").distinct().orderBy("file").collect()]

    def extent(self) -> int:
        return self.ranges().agg(F.coalesce(F.max("extent"), F.lit(1))).first()[0]

    def read(self, requests: DataFrame | None = None, start: str = "start", end: str = "end") -> DataFrame:
        """All rows, or those of the files that ``requests`` touch; the schema is the stored one."""
        everything = self.spark.read.parquet(f"{self.path}/rows")
        if requests is None:
            return everything
        files = self.files_for(requests, start, end)
        if not files:
            return everything.filter(F.lit(False))
        return self.spark.read.schema(everything.schema).parquet(*files)
