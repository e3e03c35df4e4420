"""Ordered per-key computations that do not need a whole key in one task.

A key may hold a large share of all rows. Each function therefore takes a ``bucket``: a column
that grows with the order and splits a key into runs. The window runs inside (key, bucket); what
has to cross a bucket edge travels in a summary with one row per bucket.

The input is read twice, once for the rows and once for the summary. That is cheap for tables and
for plans whose shuffles Spark reuses; results of Python functions should be written or cut with
``session.cut_lineage`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def _bucketed(df: DataFrame, bucket: Column) -> DataFrame:
    return df.withColumn(_BUCKET, bucket.cast("bigint"))


def with_previous(
    df: DataFrame, keys: list[str], order: str, bucket: Column, values: dict[str, str]
) -> DataFrame:
    """Add, for each ``values[name]`` column, the value of the preceding row of the key as ``name``."""
    rows = _bucketed(df, bucket)
    payload = F.struct(*[F.col(source).alias(name) for name, source in values.items()])
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order)
    tails = rows.groupBy(*keys, _BUCKET).agg(F.max_by(payload, F.col(order)).alias("__tail"))
    carried = tails.select(
        *keys,
        _BUCKET,
        F.lag("__tail").over(Window.partitionBy(*keys).orderBy(_BUCKET)).alias("__carry"),
    )
    joined = rows.withColumn("__local", F.lag(payload).over(inside)).join(
        carried, [*keys, _BUCKET], "left"
    )
    previous = F.coalesce("__local", "__carry")
    return joined.select(*df.columns, *[previous[name].alias(name) for name in values])


def with_running_total(
    df: DataFrame, keys: list[str], order: str, bucket: Column, value: Column, name: str
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key that come strictly before this one."""
    rows = _bucketed(df, bucket).withColumn("__value", value)
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.sum("__value").alias("__total"))
        .select(*keys, _BUCKET, F.sum("__total").over(ahead).alias("__carry"))
    )
    joined = rows.withColumn("__local", F.sum("__value").over(inside)).join(
        carried, [*keys, _BUCKET], "left"
    )
    zero = F.lit(0)
    total = F.coalesce("__local", zero) + F.coalesce("__carry", zero)
    return joined.select(*df.columns, total.alias(name))


def with_running_max(
    df: DataFrame, keys: list[str], order: str, bucket: Column, value: Column, name: str
) -> DataFrame:
    """Add the largest ``value`` of the rows of the key that come strictly before this one."""
    rows = _bucketed(df, bucket).withColumn("__value", value)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.max("__value").alias("__most"))
        .select(*keys, _BUCKET, F.max("__most").over(ahead).alias("__carry"))
    )
    joined = rows.withColumn("__local", F.max("__value").over(inside)).join(carried, [*keys, _BUCKET], "left")
    return joined.select(*df.columns, F.greatest("__local", "__carry").alias(name))


def with_position(
    df: DataFrame, keys: list[str], order: str, bucket: Column, name: str
) -> DataFrame:
    """Add the zero-based position of the row within its key."""
    return with_running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name)
