"""Sections from model activations: probabilities, marker folding, labels and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.operators.joins import attach, points_in_intervals

# The label vocabulary in model order.
LABELS = (
    "start", "end", "intro", "outro", "break", "bridge", "instrumental", "solo", "verse", "chorus",
)
FRAMES_PER_SECOND = 100.0
# Frames per cell of the frame-in-section join.
CELL_FRAMES = 4_096.0

KEYS = ["recording_id", "model"]


def activation_probabilities(activations: DataFrame) -> DataFrame:
    """Logits to probabilities: independent for beat, downbeat and boundary, joint for labels."""
    return activations.select(
        *KEYS,
        "frame",
        X.sigmoid(F.col("beat_logit").cast("double")).alias("beat_probability"),
        X.sigmoid(F.col("downbeat_logit").cast("double")).alias("downbeat_probability"),
        X.sigmoid(F.col("boundary_logit").cast("double")).alias("boundary_probability"),
        X.softmax("label_logits").alias("label_probability"),
    )


def fold_markers(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Drop a leading start marker and a trailing end marker into their neighbours.

    ``segment_index`` counts up by one. A marker that is the only segment left stays.
    ``recordings`` needs recording_id and duration_seconds; without a row there the last end stays as it is.
    """
    ends = segments.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("segment_index").alias("__first"),
        F.min_by("label", "segment_index").alias("__first_label"),
        F.max_by("label", "segment_index").alias("__last_label"),
    ).join(recordings.select("recording_id", "duration_seconds"), "recording_id", "left")
    opening = (F.col("__n") > 1) & (F.col("__first_label") == "start")
    left = F.col("__n") - F.when(opening, 1).otherwise(0)
    flagged = ends.withColumn("__open", opening).withColumn(
        "__close", (left > 1) & (F.col("__last_label") == "end")
    )
    at = F.col("segment_index") - F.col("__first")
    skip = F.when(F.col("__open"), 1).otherwise(0)
    kept_last = F.col("__n") - 1 - F.when(F.col("__close"), 1).otherwise(0)
    return (
        attach(segments, flagged, KEYS, "segment_index", "inner")
        .filter((at >= skip) & (at <= kept_last))
        .select(
            *KEYS,
            (at - skip).alias("section_index"),
            F.when(F.col("__open") & (at == 1), F.lit(0.0)).otherwise(F.col("start")).alias("start"),
            F.when(F.col("__close") & (at == kept_last), F.coalesce("duration_seconds", "end"))
            .otherwise(F.col("end"))
            .alias("end"),
            X.functional_label("label").alias("label"),
            (kept_last - skip + 1).alias("section_count"),
            "duration_seconds",
        )
    )


def snap_segments(folded: DataFrame) -> DataFrame:
    """Clamp to the recording, if its duration is known; the first section starts at zero and the last ends with it."""
    duration = F.col("duration_seconds")
    start = F.greatest(F.lit(0.0), F.least(F.col("start"), duration))
    end = F.greatest(start, F.least(F.col("end"), duration))
    return folded.select(
        *KEYS,
        "section_index",
        F.when(F.col("section_index") == 0, F.lit(0.0)).otherwise(start).alias("start_seconds"),
        F.when(F.col("section_index") == F.col("section_count") - 1, F.coalesce(duration, end)).otherwise(end).alias("end_seconds"),
        "label",
    )


def section_frames(sections: DataFrame, frame_counts: DataFrame, fps: float = FRAMES_PER_SECOND) -> DataFrame:
    """First and one-past-last activation frame of each section, at least one frame long; null without activations."""
    counted = attach(sections, frame_counts, KEYS, "section_index")
    known = lambda value: F.when(F.col("frames").isNotNull(), value)
    first = known(F.least(F.col("frames") - 1, F.greatest(F.lit(0), X.half_even(F.col("start_seconds") * F.lit(fps)))))
    return counted.withColumn("start_frame", first).withColumn(
        "end_frame",
        known(F.least(
            F.col("frames"),
            F.greatest(F.col("start_frame") + 1, X.half_even(F.col("end_seconds") * F.lit(fps))),
        )),
    ).drop("frames")


def frames_in_sections(frames: DataFrame, sections: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Pair every frame with the sections whose half-open frame range holds it."""
    return points_in_intervals(
        frames, sections, keys, frame, "start_frame", "end_frame", CELL_FRAMES, include_start=True
    )


def top_labels(distribution: Column, labels: tuple[str, ...], count: int = 3) -> Column:
    """The most probable labels as (label, probability); equal ones in vocabulary order."""
    vocabulary = F.array(*[F.lit(name) for name in labels])
    entries = F.transform(
        distribution,
        lambda p, i: F.struct(
            p.alias("probability"), (-i).alias("order"), F.get(vocabulary, i).alias("label")
        ),
    )
    best = F.slice(F.sort_array(entries, asc=False), 1, count)
    return F.transform(best, lambda e: F.struct(e["label"].alias("label"), e["probability"].alias("probability")))


def label_confidence(distribution: Column, label: Column, labels: tuple[str, ...]) -> Column:
    """Probability of the section's own label, or of the best label when it is not in the list."""
    vocabulary = F.array(*[F.lit(name) for name in labels])
    own = F.get(distribution, F.array_position(vocabulary, label).cast("int") - 1)
    return F.coalesce(own, F.array_max(distribution))


def section_distributions(
    frames: DataFrame, sections: DataFrame, keys: list[str], vector: str, size: int, extra: list[Column] | None = None,
    frame: str = "frame",
) -> DataFrame:
    """Mean vector of the frames of each section; sums are combined before the shuffle."""
    return (
        frames_in_sections(frames, sections, keys, frame)
        .groupBy(*keys, "section_index")
        .agg(X.mean_vector(vector, size).alias("distribution"), *(extra or []))
    )


def learned_sections(
    activations: DataFrame,
    segments: DataFrame,
    recordings: DataFrame,
    meta: DataFrame | None = None,
    labels: tuple[str, ...] = LABELS,
    fps: float = FRAMES_PER_SECOND,
) -> DataFrame:
    """Labelled sections with confidences, alternatives, sample positions and frame ranges.

    ``recordings`` needs recording_id, duration_seconds, sample_rate_hz and frame_count. Sections without
    activations have no confidences, those without a recording no samples; ``learned_violations`` lists them.
    """
    probabilities = activation_probabilities(activations)
    frame_counts = activations.groupBy(*KEYS).agg((F.max("frame") + 1).alias("frames"))
    sections = section_frames(snap_segments(fold_markers(segments, recordings)), frame_counts, fps)
    at_start = F.max(F.when(F.col("frame") == F.col("start_frame"), F.col("boundary_probability")))
    measured = section_distributions(
        probabilities, sections.select(*KEYS, "section_index", "start_frame", "end_frame"), KEYS,
        "label_probability", len(labels), [at_start.alias("boundary_confidence")],
    )
    known = sections.join(measured, [*KEYS, "section_index"], "left").select(
        "recording_id",
        F.col("model").alias("hypothesis_id"),
        "section_index",
        "start_seconds",
        "end_seconds",
        "label",
        F.lit("learned_functional_label").alias("label_kind"),
        label_confidence(F.col("distribution"), F.col("label"), labels).alias("confidence"),
        "boundary_confidence",
        top_labels(F.col("distribution"), labels).alias("label_hypotheses"),
    )
    return TL.align_intervals(known, recordings, meta, "section_index")


def learned_violations(activations: DataFrame, segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Hypotheses of which the segments, the activations or the recording are missing."""
    sides = activations.select(*KEYS, F.lit("activations").alias("side")).unionByName(
        segments.select(*KEYS, F.lit("segments").alias("side"))
    )
    held = sides.groupBy(*KEYS).agg(F.collect_set("side").alias("sides"))
    known = recordings.select("recording_id", F.lit("recording").alias("known")).distinct()
    wanted = F.array(*[F.lit(x) for x in ("activations", "segments", "recording")])
    missing = F.array_except(wanted, F.concat("sides", F.array_compact(F.array("known"))))
    return held.join(known, "recording_id", "left").select("recording_id", "model", F.explode(missing).alias("side")).select(
        "recording_id", *TL.violation("learned", F.concat(F.lit("missing_"), F.col("side")), F.col("model"), F.lit(None))
    )


def tempo_from_beats(beats: DataFrame, keys: list[str], seconds: str = "seconds", run: float = 600.0) -> DataFrame:
    """The most frequent whole tempo between consecutive beats; the slower one on a tie."""
    from songframe.operators.ordered import with_previous

    paired = with_previous(
        beats.select(*keys, seconds), keys, seconds, F.floor(F.col(seconds) / F.lit(run)), {"__previous": seconds}
    )
    gap = F.col(seconds) - F.col("__previous")
    counted = (
        paired.filter(gap > 0)
        .groupBy(*keys, X.half_even(F.lit(60.0) / gap).alias("tempo_bpm"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    return counted.groupBy(*keys).agg(
        F.max_by("tempo_bpm", F.struct(F.col("__n"), -F.col("tempo_bpm"))).alias("tempo_bpm")
    )
