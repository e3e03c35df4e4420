"""Interval timelines: continuity, order, sample positions and spectrogram frame ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators.joins import attach
from songframe.operators.ordered import with_previous

# Rows per bucket of an index-ordered timeline.
RUN = 4_096


def violation(stage: str, check, subject, detail, severity: str = "error") -> list[Column]:
    """The columns every violation table shares, after ``recording_id``."""
    as_text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return [
        F.lit(stage).alias("stage"),
        as_text(check).alias("check"),
        as_text(subject).alias("subject"),
        F.lit(severity).alias("severity"),
        as_text(detail).alias("detail"),
    ]


def intervals_between(
    df: DataFrame, keys: list[str], boundary: str, run_seconds: float = 1_024.0
) -> DataFrame:
    """Consecutive boundaries of a key as (start_seconds, end_seconds)."""
    ends = df.select(*keys, F.col(boundary).alias("end_seconds"))
    paired = with_previous(
        ends,
        keys,
        "end_seconds",
        F.floor(F.col("end_seconds") / F.lit(run_seconds)),
        {"start_seconds": "end_seconds"},
    )
    return paired.filter(F.col("start_seconds").isNotNull()).select(
        *keys, "start_seconds", "end_seconds"
    )


def contiguity_violations(
    intervals: DataFrame, durations: DataFrame, keys: list[str], index: str, stage: str
) -> DataFrame:
    """Every place where intervals fail to cover [0, duration] without gap or overlap.

    ``durations`` holds one row per key with ``duration_seconds``; a key without intervals is
    reported as well.
    """
    chained = with_previous(
        intervals.select(*keys, index, "start_seconds", "end_seconds"),
        keys,
        index,
        F.floor(F.col(index) / RUN),
        {"previous_end": "end_seconds"},
    ).withColumn("previous_end", F.coalesce("previous_end", F.lit(0.0)))
    timed = attach(chained, durations.select(*keys, "duration_seconds"), keys, index)
    gap = F.abs(F.col("start_seconds") - F.col("previous_end")) > X.TOLERANCE
    empty = F.col("end_seconds") <= F.col("start_seconds")
    late = F.col("end_seconds") > F.col("duration_seconds") + X.TOLERANCE
    found = F.filter(
        F.array(
            F.when(gap, F.lit("discontinuous")),
            F.when(empty, F.lit("non_positive")),
            F.when(late, F.lit("past_end")),
        ),
        lambda c: c.isNotNull(),
    )
    inner = timed.withColumn("__check", F.explode(found)).select(
        *keys, *violation(stage, F.col("__check"), F.col(index), F.concat_ws(
            "..", F.col("previous_end"), F.col("start_seconds"), F.col("end_seconds")))
    )
    # The last interval decides coverage; a partial max per key is all that moves.
    last = intervals.groupBy(*keys).agg(
        F.max_by("end_seconds", index).alias("__last_end"), F.count(F.lit(1)).alias("__n")
    )
    outer = (
        durations.join(last, keys, "left")
        .filter(
            F.col("__n").isNull()
            | (F.abs(F.col("__last_end") - F.col("duration_seconds")) > X.TOLERANCE)
        )
        .select(*keys, *violation(
            stage,
            F.when(F.col("__n").isNull(), F.lit("missing_intervals")).otherwise(F.lit("incomplete")),
            F.lit("timeline"),
            F.col("__last_end"),
        ))
    )
    return inner.unionByName(outer)


def order_violations(
    points: DataFrame,
    durations: DataFrame,
    keys: list[str],
    index: str,
    seconds: str,
    stage: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Points that do not strictly increase, or that lie outside [0, duration]."""
    chained = with_previous(
        points.select(*keys, index, seconds),
        keys,
        index,
        F.floor(F.col(index) / RUN) if bucket is None else bucket,
        {"__previous": seconds},
    )
    timed = attach(chained, durations.select(*keys, "duration_seconds"), keys, index)
    found = F.filter(
        F.array(
            F.when(F.col(seconds) <= F.col("__previous"), F.lit("not_increasing")),
            F.when(F.col(seconds) < 0, F.lit("before_start")),
            F.when(F.col(seconds) > F.col("duration_seconds"), F.lit("past_end")),
        ),
        lambda c: c.isNotNull(),
    )
    return timed.withColumn("__check", F.explode(found)).select(
        *keys, *violation(stage, F.col("__check"), F.col(index), F.col(seconds))
    )


def axes_by_recording(meta: DataFrame, track: str = "mixture") -> DataFrame:
    """One row per recording: the spectrogram axes of a track as an array of structs.

    A recording has one axis per configuration, so the array stays a handful of entries long.
    """
    return (
        meta.filter(F.col("track") == track)
        .groupBy("recording_id", "config")
        .agg(F.max(F.struct("n_fft", "hop_length", "sample_rate_hz", "time_frames")).alias("axis"))
        .groupBy("recording_id")
        .agg(F.sort_array(F.collect_list(F.struct("config", "axis"))).alias("axes"))
    )


def frame_range(axis: Column) -> Column:
    """Struct of the first frame at or after the start and at or after the end of the row."""
    edge = lambda name: X.frames_before(
        F.col(name), axis["n_fft"], axis["hop_length"], axis["sample_rate_hz"], axis["time_frames"]
    )
    return F.struct(edge("start_seconds").alias("start"), edge("end_seconds").alias("end"))


def align_intervals(
    intervals: DataFrame, recordings: DataFrame, meta: DataFrame | None, spread_by: str
) -> DataFrame:
    """Add sample positions and the frame range on every spectrogram axis.

    ``recordings`` needs recording_id, sample_rate_hz and frame_count.
    """
    attributes = recordings.select("recording_id", "sample_rate_hz", "frame_count")
    if meta is not None:
        attributes = attributes.join(axes_by_recording(meta), "recording_id", "left")
    else:
        attributes = attributes.withColumn(
            "axes",
            F.lit(None).cast(
                "array<struct<config:string,axis:struct<n_fft:int,hop_length:int,"
                "sample_rate_hz:int,time_frames:bigint>>>"
            ),
        )
    placed = attach(intervals, attributes, ["recording_id"], spread_by)
    ranges = F.map_from_entries(
        F.transform(
            F.coalesce("axes", F.array()),
            lambda a: F.struct(a["config"].alias("key"), frame_range(a["axis"]).alias("value")),
        )
    )
    return placed.select(
        *intervals.columns,
        X.start_sample("start_seconds", "sample_rate_hz").alias("start_sample"),
        X.end_sample("end_seconds", "sample_rate_hz", "frame_count").alias("end_sample"),
        ranges.alias("spectrogram_frames"),
    )


def boundary_set(boundaries: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Boundaries clipped to the recording, with both ends added, each once."""
    clipped = attach(boundaries, durations.select(*keys, "duration_seconds"), keys, "seconds", "inner")
    inside = clipped.select(
        *keys, F.greatest(F.lit(0.0), F.least(F.col("duration_seconds"), F.col("seconds"))).alias("seconds")
    )
    ends = durations.select(*keys, F.explode(F.array(F.lit(0.0), F.col("duration_seconds"))).alias("seconds"))
    return inside.unionByName(ends).distinct()
