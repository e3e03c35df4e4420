"""Stems whose level drifts or that fall silent, found by sequential change detection over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.operators import timeline as TL
from songframe.operators.ordered import with_previous, with_running_max, with_running_total

# Levels are whole hundredths of a decibel, so that sums don't depend on how rows are dealt out.
UNITS = 100
SILENT_LEVEL = -120 * UNITS
# A level has to be off its mean by more than the slack; what is beyond adds up to the alarm.
SLACK, ALARM = 3 * UNITS, 60 * UNITS
# Vocals this far below the mixture count as missing, from so many blocks in a row on.
MISSING_BELOW, MISSING_BLOCKS = 40 * UNITS, 4
# Blocks of a track that one window of the ordered pass sees.
RUN_BLOCKS = 1_024


def block_levels(blocks: DataFrame) -> DataFrame:
    """recording_id, track, block_index, level: root mean square of all channels, in whole hundredths of dBFS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = []
            for samples in batch.column("samples"):
                parts = [c.values.to_numpy(zero_copy_only=False).astype(np.float64) for c in samples.values] if samples.is_valid and samples.values is not None else []
                energy, n = sum(float(p @ p) for p in parts), sum(len(p) for p in parts)
                power = energy / n if n else 0.0
                levels.append(max(SILENT_LEVEL, round(10 * np.log10(power) * UNITS)) if power > 0 else SILENT_LEVEL)
            names = ["recording_id", "track", "block_index"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(levels, pa.int64())], [*names, "level"])

    chosen = blocks.select(F.col("recording_id").cast("string"), "track", F.col("block_index").cast("bigint"), "samples")
    return chosen.mapInArrow(run, "recording_id string, track string, block_index bigint, level bigint")


def change_alarms(
    levels: DataFrame, keys: list[str], order: str, value: str = "level", slack: int = SLACK, alarm: int = ALARM, bucket: Column | None = None
) -> DataFrame:
    """(keys, order, direction, excess): where a level has moved away from the key's mean for too long.

    Both ways, s becomes max(0, s + deviation - slack) from row to row, and an alarm is a row at which s
    reaches ``alarm`` from below. With c the running sum of what is added, s is c less the least c so far
    (or less 0), so a running sum and a running minimum give every s at once, over any number of buckets.
    ``value`` is whole; so is the mean, rounded down. Null values count as the mean.
    """
    bucket = F.floor(F.col(order) / RUN_BLOCKS) if bucket is None else bucket
    means = levels.groupBy(*keys).agg(F.floor(F.sum(value) / F.count(value)).alias("__mean"))
    rows = levels.select(*keys, order, value).join(means, keys)
    off = F.coalesce(F.col(value) - F.col("__mean"), F.lit(0).cast("bigint"))
    out = []
    for direction, step in (("up", off - slack), ("down", -off - slack)):
        stepped = rows.withColumn("__step", step)
        summed = with_running_total(stepped, keys, order, bucket, F.col("__step"), "__before").withColumn("__sum", F.col("__before") + F.col("__step"))
        lowest = with_running_max(summed, keys, order, bucket, -F.col("__sum"), "__low")
        # the least running sum up to and with this row, as its negative
        low = F.greatest(F.lit(0).cast("bigint"), F.col("__low"), -F.col("__sum"))
        excess = lowest.withColumn("excess", F.col("__sum") + low)
        chained = with_previous(excess.select(*keys, order, "excess"), keys, order, bucket, {"__was": "excess"})
        reached = (F.col("excess") >= alarm) & (F.coalesce("__was", F.lit(0)) < alarm)
        out.append(chained.filter(reached).select(*keys, order, F.lit(direction).alias("direction"), "excess"))
    return out[0].unionByName(out[1])


def missing_runs(
    levels: DataFrame, stem: str = "vocals", below: int = MISSING_BELOW, blocks: int = MISSING_BLOCKS
) -> DataFrame:
    """recording_id, last_block, blocks: stretches of at least ``blocks`` blocks in which a stem is missing.

    A block counts if the mixture is heard and the stem lies ``below`` or more under it, or has no block.
    """
    of = lambda name: F.max(F.when(F.col("track") == name, F.col("level")))
    both = levels.groupBy("recording_id", "block_index").agg(of("mixture").alias("mix"), of(stem).alias("stem"))
    gone = (F.col("mix") > SILENT_LEVEL) & (F.coalesce("stem", F.lit(SILENT_LEVEL)) <= F.col("mix") - below)
    rows = both.select("recording_id", "block_index", F.coalesce(gone, F.lit(False)).alias("gone"))
    bucket = F.floor(F.col("block_index") / RUN_BLOCKS)
    keys = ["recording_id"]
    present = F.when(~F.col("gone"), F.col("block_index"))
    rows = with_running_max(rows, keys, "block_index", bucket, present, "__present")
    rows = with_running_max(rows.withColumn("__one", -F.col("block_index")), keys, "block_index", bucket, F.col("__one"), "__first")
    begins = F.coalesce(F.col("__present") + 1, -F.col("__first"), F.col("block_index"))
    rows = rows.withColumn("run", F.when(F.col("gone"), F.col("block_index") - begins + 1))
    # a stretch ends where the next block is not part of it
    after = with_previous(rows.withColumn("__back", -F.col("block_index")), keys, "__back", F.floor(F.col("__back") / RUN_BLOCKS), {"__next": "run"})
    return after.filter(F.col("gone") & F.col("__next").isNull() & (F.col("run") >= blocks)).select(
        "recording_id", F.col("block_index").alias("last_block"), F.col("run").cast("bigint").alias("blocks")
    )


def drift_violations(levels: DataFrame, slack: int = SLACK, alarm: int = ALARM) -> DataFrame:
    """Level changes of any stem and stretches without vocals, as warnings."""
    stems = levels.filter(F.col("track") != "mixture")
    moved = change_alarms(stems, ["recording_id", "track"], "block_index", "level", slack, alarm)
    drifted = moved.select("recording_id", *TL.violation("separation", F.concat(F.lit("level_"), F.col("direction")), F.concat_ws("/", "track", "block_index"), F.col("excess"), "warn"))
    lost = missing_runs(levels).select("recording_id", *TL.violation("separation", "missing_vocals", F.col("last_block"), F.col("blocks"), "warn"))
    return drifted.unionByName(lost)
