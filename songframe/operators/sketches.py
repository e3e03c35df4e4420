"""Quantiles of quality measures by group, from sketches that can be stored per shard and merged later."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Relative error of any quantile of non-zero values.
ACCURACY = 0.01
QUANTILES = (0.1, 0.5, 0.9)


def growth(accuracy: float = ACCURACY) -> float:
    """How much wider each bucket is than the one before."""
    return (1 + accuracy) / (1 - accuracy)


def sketch(df: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, sign, bucket, n): counts of values in buckets whose bounds grow by a constant factor.

    A key has at most some ten thousand buckets, however many values it has; partial counts are added up
    before the shuffle. Null and not-a-number values are left out, infinite ones keep a bucket each.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    bucket = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit((1 << 31) - 1)).otherwise(F.ceil(F.log(size) / math.log(growth(accuracy))))
    real = df.filter(v.isNotNull() & ~F.isnan(v))
    return real.groupBy(*keys, F.signum(v).cast("int").alias("sign"), bucket.cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One sketch of all values that went into several of the same accuracy; the order doesn't matter."""
    return reduce(DataFrame.unionByName, sketches).groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(
    sketched: DataFrame, keys: list[str], wanted: tuple[float, ...] = QUANTILES, accuracy: float = ACCURACY
) -> DataFrame:
    """(keys, quantile, count, estimate): within ``accuracy`` of the least value at or above the rank, relatively.

    The window sees the buckets of a key, not its values.
    """
    along = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    whole = Window.partitionBy(*keys)
    rows = sketched.withColumns({
        "__upto": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)), "__count": F.sum("n").over(whole),
    })
    rows = rows.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in wanted])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("__count")))
    rows = rows.filter((F.col("__upto") >= rank) & (F.col("__upto") - F.col("n") < rank))
    g = growth(accuracy)
    middle = F.when(F.col("bucket") == (1 << 31) - 1, F.lit(float("inf"))).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    estimate = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * middle)
    return rows.select(*keys, "quantile", F.col("__count").alias("count"), estimate.alias("estimate"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The values that ``quantiles`` estimates, from counts of distinct values; for tests and small tables."""
    found = df.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(float(q)).alias("quantile"), F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double").alias("exact")) for q in wanted
    ]).alias("q"))
    return found.select(*keys, F.inline("q"))
