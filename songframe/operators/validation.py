"""Cross-artifact validation of a whole catalog."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.operators import defects as DF
from songframe.operators import frames as FR
from songframe.operators import learned as LN
from songframe.operators import passages as PS
from songframe.operators import separation as SP
from songframe.operators import timeline as TL
from songframe.operators.lineage import hash_violations, lineage_violations


@dataclass(frozen=True)
class CatalogTables:
    """What validation reads. Tables left out are not checked.

    recordings: recording_id, path, sha256, sample_rate_hz, frame_count, channels, duration_seconds
    spectrograms: spectrogram meta rows of every track
    spectrogram_parents: recording_id, track, sha256 (waves the spectrograms were made from)
    separations: recording_id, parent_sha256
    stems: recording_id, stem, path, sha256, sample_rate_hz, frame_count, channels
    structures: recording_id, hypothesis_id, sha256, parent_sha256
    sections, passages: interval tables keyed by recording and hypothesis
    passage_sets: recording_id, hypothesis_id, structure_sha256
    passage_stems: recording_id, hypothesis_id, stem, sha256
    feature_shapes: output of ``frames.feature_shapes``
    files: path, sha256 measured by the file scan
    spectrogram_axes: recording_id, track, config, frame_index, center_seconds as they are stored
    activations, segments: recording_id, model of learned hypotheses, one row or more each
    mixture_blocks, stem_blocks: waveform blocks that the separation is measured on
    defects: output of ``defects.recording_defects``
    """

    recordings: DataFrame
    spectrograms: DataFrame | None = None
    spectrogram_parents: DataFrame | None = None
    separations: DataFrame | None = None
    stems: DataFrame | None = None
    structures: DataFrame | None = None
    sections: DataFrame | None = None
    passage_sets: DataFrame | None = None
    passages: DataFrame | None = None
    passage_stems: DataFrame | None = None
    feature_shapes: DataFrame | None = None
    separation_metrics: DataFrame | None = None
    files: DataFrame | None = None
    spectrogram_axes: DataFrame | None = None
    activations: DataFrame | None = None
    segments: DataFrame | None = None
    mixture_blocks: DataFrame | None = None
    stem_blocks: DataFrame | None = None
    defects: DataFrame | None = None


SHARED = ["recording_id", "stage", "check", "subject", "severity", "detail"]


def _edges(df: DataFrame, stage: str, child, parent_kind, claimed: str) -> DataFrame:
    as_col = lambda v: v if not isinstance(v, str) else F.lit(v)
    return df.select(
        "recording_id",
        F.lit(stage).alias("stage"),
        as_col(child).alias("child"),
        as_col(parent_kind).alias("parent_kind"),
        F.col(claimed).alias("claimed_sha256"),
    )


def _artifacts(df: DataFrame, kind, digest: str = "sha256") -> DataFrame:
    return df.select(
        "recording_id",
        (kind if not isinstance(kind, str) else F.lit(kind)).alias("parent_kind"),
        F.col(digest).alias("sha256"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*t.columns) for t in tables])


def lineage_tables(t: CatalogTables) -> tuple[DataFrame, DataFrame]:
    """All (child, claimed parent hash) edges and all parents with their actual hash."""
    edges: list[DataFrame] = []
    artifacts = [_artifacts(t.recordings, "wave:mixture")]
    if t.spectrogram_parents is not None:
        stems = t.spectrogram_parents.filter(F.col("track") != "mixture")
        artifacts.append(_artifacts(stems, F.concat(F.lit("wave:"), F.col("track"))))
    if t.spectrograms is not None:
        edges.append(_edges(
            t.spectrograms, "spectrogram", F.concat_ws("/", "track", "config"),
            F.concat(F.lit("wave:"), F.col("track")), "parent_sha256",
        ))
    if t.separations is not None:
        edges.append(_edges(t.separations, "separation", "separation", "wave:mixture", "parent_sha256"))
    if t.structures is not None:
        edges.append(_edges(t.structures, "structure", F.col("hypothesis_id"), "wave:mixture", "parent_sha256"))
        artifacts.append(_artifacts(t.structures, F.concat(F.lit("structure:"), F.col("hypothesis_id"))))
    if t.passage_sets is not None:
        edges.append(_edges(
            t.passage_sets, "passages", F.col("hypothesis_id"),
            F.concat(F.lit("structure:"), F.col("hypothesis_id")), "structure_sha256",
        ))
    if t.passage_stems is not None and t.stems is not None:
        edges.append(_edges(
            t.passage_stems, "passages", F.concat_ws("/", "hypothesis_id", "stem"),
            F.concat(F.lit("stem:"), F.col("stem")), "sha256",
        ))
        artifacts.append(_artifacts(t.stems, F.concat(F.lit("stem:"), F.col("stem"))))
    if not edges:
        edges.append(_edges(t.recordings.filter(F.lit(False)), "none", "none", "none", "sha256"))
    return _union(edges), _union(artifacts)


def _missing(recordings: DataFrame, table: DataFrame, stage: str) -> DataFrame:
    """Recordings without any row in a stage's table."""
    return recordings.join(table.select("recording_id").distinct(), "recording_id", "left_anti").select(
        "recording_id", *TL.violation(stage, "missing_artifact", stage, F.lit(None))
    )


def _axis_violations(meta: DataFrame, recordings: DataFrame) -> DataFrame:
    """Spectrograms whose last frame centre lies past the recording."""
    return (
        meta.join(recordings.select("recording_id", "duration_seconds"), "recording_id")
        .filter(F.col("last_frame_center_seconds") > F.col("duration_seconds") + TL.X.TOLERANCE)
        .select(
            "recording_id",
            *TL.violation(
                "spectrogram", "past_end", F.concat_ws("/", "track", "config"), F.col("last_frame_center_seconds")
            ),
        )
    )


def stored_axis_violations(axes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Stored frame centres that don't strictly increase or lie outside the recording."""
    keys = ["recording_id", "track", "config"]
    durations = axes.select(*keys).distinct().join(
        recordings.select("recording_id", (F.col("duration_seconds") + TL.X.TOLERANCE).alias("duration_seconds")), "recording_id"
    )
    found = TL.order_violations(axes, durations, keys, "frame_index", "center_seconds", "spectrogram")
    return found.withColumn("subject", F.concat_ws("/", "track", "config", "subject"))


def _per_hypothesis(recordings: DataFrame, structures: DataFrame) -> DataFrame:
    return structures.select("recording_id", "hypothesis_id").join(
        recordings.select("recording_id", "duration_seconds"), "recording_id"
    )


def catalog_violations(t: CatalogTables) -> DataFrame:
    """Every problem of every recording as one row."""
    parts = [lineage_violations(*lineage_tables(t))]
    if t.files is not None:
        waves = t.recordings.select("recording_id", F.lit("mixture").alias("subject"), "path", "sha256")
        parts.append(hash_violations(waves, t.files, "canonical"))
        if t.stems is not None:
            stem_files = t.stems.select("recording_id", F.col("stem").alias("subject"), "path", "sha256")
            parts.append(hash_violations(stem_files, t.files, "separation"))
    if t.spectrograms is not None:
        parts += [_missing(t.recordings, t.spectrograms, "spectrogram"),
                  _axis_violations(t.spectrograms, t.recordings), FR.short_recordings(t.spectrograms)]
    if t.spectrogram_axes is not None:
        parts.append(stored_axis_violations(t.spectrogram_axes, t.recordings))
    if t.separations is not None:
        parts.append(_missing(t.recordings, t.separations, "separation"))
    if t.mixture_blocks is not None and t.stem_blocks is not None:
        parts.append(SP.block_violations(t.mixture_blocks, t.stem_blocks))
    if t.activations is not None and t.segments is not None:
        parts.append(LN.learned_violations(t.activations, t.segments, t.recordings))
    if t.defects is not None:
        parts.append(DF.defect_violations(t.defects, t.recordings))
    if t.stems is not None:
        parts += [SP.contract_violations(t.recordings, t.stems), SP.alignment_violations(t.recordings, t.stems)]
    if t.separation_metrics is not None:
        parts.append(SP.quality_violations(t.separation_metrics))
    if t.structures is not None:
        parts.append(_missing(t.recordings, t.structures, "structure"))
        if t.sections is not None:
            parts.append(TL.contiguity_violations(
                t.sections, _per_hypothesis(t.recordings, t.structures),
                ["recording_id", "hypothesis_id"], "section_index", "structure",
            ))
    if t.passage_sets is not None:
        parts.append(_missing(t.recordings, t.passage_sets, "passages"))
        if t.passages is not None:
            parts.append(PS.passage_violations(t.passages, _per_hypothesis(t.recordings, t.passage_sets)))
    if t.feature_shapes is not None:
        parts.append(FR.stem_shape_violations(t.feature_shapes, t.recordings))
    return reduce(DataFrame.unionByName, [p.select(*SHARED) for p in parts])


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("recording_id").agg(F.count(F.lit(1)).alias(name))


def roll_up(recordings: DataFrame, violations: DataFrame, counters: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per recording: valid or not, errors and warnings, failed checks, item counts.

    The report names each failed check once and counts its rows; the rows themselves stay in the
    violations table, so a recording with very many problems does not make one very large cell.
    """
    error = F.col("severity") == "error"
    per_check = violations.groupBy("recording_id", "stage", "check", "severity").agg(
        F.count(F.lit(1)).alias("n")
    )
    summary = per_check.groupBy("recording_id").agg(
        F.sum(F.when(error, F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(error, 0).otherwise(F.col("n"))).alias("warnings"),
        F.sort_array(
            F.collect_list(F.when(error, F.concat_ws(" ", F.concat_ws(".", "stage", "check"), "n")))
        ).alias("failed_checks"),
    )
    report = recordings.select("recording_id").join(summary, "recording_id", "left")
    names = list(counters or {})
    for name in names:
        report = report.join(_counted(counters[name], name), "recording_id", "left")
    zero = F.lit(0).cast("bigint")
    return report.select(
        "recording_id",
        (F.coalesce("errors", zero) == 0).alias("valid"),
        F.coalesce("errors", zero).alias("errors"),
        F.coalesce("warnings", zero).alias("warnings"),
        F.coalesce("failed_checks", F.array().cast("array<string>")).alias("failed_checks"),
        *[F.coalesce(n, zero).alias(n) for n in names],
    )


def validate_catalog(t: CatalogTables) -> tuple[DataFrame, DataFrame]:
    """(violations, report)."""
    violations = catalog_violations(t)
    counters = {
        f"{f.name}_count": getattr(t, f.name)
        for f in fields(t)
        if f.name in ("spectrograms", "stems", "sections", "passages") and getattr(t, f.name) is not None
    }
    return violations, roll_up(t.recordings, violations, counters)
