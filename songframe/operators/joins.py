"""Joins that keep working when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many ways an attribute row is replicated so that the detail rows of one key can be spread over
# that many tasks. Adaptive execution splits large partitions of a join by itself, so the default is
# not to copy; more is for keys known to be hot where it cannot, as under an aggregate.
SPREAD = 1


def attach(
    detail: DataFrame, attributes: DataFrame, on: list[str], spread_by: str | Column, how: str = "left",
    spread: int = SPREAD,
) -> DataFrame:
    """Join one attribute row per key to many detail rows.

    With ``spread`` above 1, detail rows of one key are split by a hash of ``spread_by``, and the
    attribute row is copied once per split. The answer is unchanged.
    """
    if spread == 1:
        return detail.join(attributes, on, how)
    column = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    salted = detail.withColumn("__salt", F.pmod(F.xxhash64(column), F.lit(spread)).cast("int"))
    copies = attributes.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(spread)])))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: str,
    start: str,
    end: str,
    width: float,
    include_start: bool = False,
) -> DataFrame:
    """Pair each point with the intervals of its key that contain it.

    Points carry the number of the cell they fall in and intervals are listed once per cell they
    touch, so the join is an equi-join on (key, cell) and never pairs a whole key with itself.
    ``include_start`` selects half-open intervals; otherwise both ends are excluded.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    placed = points.withColumn("__cell", cell(point))
    listed = intervals.filter(F.col(end) > F.col(start)).withColumn(
        "__cell", F.explode(F.sequence(cell(start), cell(end)))
    )
    lower = F.col(point) >= F.col(start) if include_start else F.col(point) > F.col(start)
    return (
        placed.join(listed, [*keys, "__cell"]).filter(lower & (F.col(point) < F.col(end))).drop("__cell")
    )


def overlapping(
    left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, other_start: str, other_end: str, width: float
) -> DataFrame:
    """Pair the intervals of two tables that share more than a point.

    Both are listed once per cell they touch; a pair is taken in the one cell where it begins.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")

    def listed(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.filter(F.col(b) > F.col(a)).withColumn("__cell", F.explode(F.sequence(cell(a), cell(b))))

    met = listed(left, start, end).join(listed(right, other_start, other_end), [*keys, "__cell"])
    begin = F.greatest(start, other_start)
    first = F.floor(begin / F.lit(width)).cast("bigint") == F.col("__cell")
    return met.filter(first & (F.least(end, other_end) > begin)).drop("__cell")
