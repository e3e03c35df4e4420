"""Stem contract, alignment and reconstruction quality for a whole catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.operators.frames import _channels
from songframe.operators.joins import attach

# Stem order of the sum, and the accepted normalised error.
REQUIRED_STEMS = ("vocals", "drums", "bass", "other")
MAXIMUM_ERROR = 0.15
CLAMP = 0.99


@dataclass(frozen=True)
class SeparationConfig:
    required_stems: tuple[str, ...] = REQUIRED_STEMS
    maximum_error: float = MAXIMUM_ERROR


# A separation backend turns mixture blocks into stem blocks of the same shape.
Backend = Callable[[DataFrame], DataFrame]


def pcm_to_float(samples: str | Column, bits) -> Column:
    """Integer samples of every channel scaled to single precision."""
    return X.let(
        X.pcm_scale(bits).cast("float"),
        lambda scale: F.transform(
            samples, lambda c: F.transform(c, lambda x: (x.cast("float") / scale).cast("float"))
        ),
    )


def downmix(samples: str | Column) -> Column:
    """Mean over the channels of a block, in single precision."""

    def mean(channels: Column) -> Column:
        total = F.aggregate(
            F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))),
            F.get(channels, F.lit(0)),
            lambda acc, c: F.zip_with(acc, c, lambda a, b: (a + b).cast("float")),
        )
        return X.let(F.size(channels), lambda n: F.transform(total, lambda x: (x / n).cast("float")))

    return X.let(samples, mean)


def track_geometry(blocks: DataFrame) -> DataFrame:
    """Length, channels and rate of each stored track."""
    return blocks.groupBy("recording_id", "track").agg(
        F.max(F.col("start_sample") + F.size(F.get("samples", 0))).cast("bigint").alias("frame_count"),
        F.max(F.size("samples")).alias("channels"),
        F.max("sample_rate_hz").alias("sample_rate_hz"),
    )


def contract_violations(
    mixtures: DataFrame, stems: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS
) -> DataFrame:
    """Stems a recording lacks and stems nobody asked for.

    ``mixtures`` lists recordings, ``stems`` has recording_id and stem. The missing side needs no
    join of names: one flag per required stem is aggregated per recording.
    """
    present = stems.filter(F.col("stem").isin(*required)).groupBy("recording_id").agg(
        *[F.max(F.when(F.col("stem") == s, True)).alias(f"__{i}") for i, s in enumerate(required)]
    )
    absent = F.filter(
        F.array(*[F.when(F.col(f"__{i}").isNull(), F.lit(s)) for i, s in enumerate(required)]),
        lambda s: s.isNotNull(),
    )
    missing = (
        mixtures.select("recording_id")
        .join(present, "recording_id", "left")
        .select("recording_id", F.explode(absent).alias("stem"))
        .select("recording_id", *TL.violation("separation", "missing_stem", F.col("stem"), F.lit(None)))
    )
    unexpected = (
        stems.filter(~F.col("stem").isin(*required))
        .select("recording_id", "stem")
        .distinct()
        .select("recording_id", *TL.violation("separation", "unexpected_stem", F.col("stem"), F.lit(None)))
    )
    return missing.unionByName(unexpected)


def alignment_violations(mixtures: DataFrame, stems: DataFrame) -> DataFrame:
    """Stems whose rate, length or channel count differs from the mixture's."""
    want = mixtures.select(
        "recording_id",
        F.col("sample_rate_hz").cast("bigint").alias("want_rate"),
        F.col("frame_count").cast("bigint").alias("want_frames"),
        F.col("channels").cast("bigint").alias("want_channels"),
    )
    checks = F.array(
        F.struct(F.lit("sample_rate").alias("check"), F.col("want_rate").alias("want"),
                 F.col("sample_rate_hz").cast("bigint").alias("got")),
        F.struct(F.lit("frame_count").alias("check"), F.col("want_frames").alias("want"),
                 F.col("frame_count").cast("bigint").alias("got")),
        F.struct(F.lit("channels").alias("check"), F.col("want_channels").alias("want"),
                 F.col("channels").cast("bigint").alias("got")),
    )
    return (
        stems.join(want, "recording_id")
        .select("recording_id", "stem", F.inline(checks))
        .filter(~F.col("want").eqNullSafe(F.col("got")))
        .select(
            "recording_id",
            *TL.violation(
                "separation", F.col("check"), F.col("stem"), F.concat_ws(" != ", F.col("got"), F.col("want"))
            ),
        )
    )


def _block_sides(mixture: DataFrame, stems: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(recording_id, block_index, sides): which of the mixture and the required stems have each block."""
    keys = ["recording_id", "block_index"]
    sides = mixture.select(*keys, F.lit("mixture").alias("side")).unionByName(
        stems.filter(F.col("track").isin(*required)).select(*keys, F.col("track").alias("side"))
    )
    return sides.groupBy(*keys).agg(F.collect_set("side").alias("sides"))


def side_by_side(
    mixture: DataFrame, stems: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS
) -> DataFrame:
    """Mixture and stem samples of each block of the mixture in one row; null for a stem that lacks it.

    Every side is keyed by (recording, block), so a long recording spreads over all tasks; tables
    bucketed on that key join without moving.
    """
    keys = ["recording_id", "block_index"]
    rows = mixture.select(*keys, "start_sample", F.col("samples").alias("mixture"))
    for stem in required:
        side = stems.filter(F.col("track") == stem).select(*keys, F.col("samples").alias(stem))
        rows = rows.join(side, keys, "left")
    return rows


def _with_lone_blocks(found: DataFrame, mixture: DataFrame, stems: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``found`` and a row of nulls for each block of its recordings that only stems have."""
    keys = ["recording_id", "block_index"]
    lone = (
        stems.filter(F.col("track").isin(*required)).select(*keys)
        .join(mixture.select("recording_id").distinct(), "recording_id", "left_semi")
        .join(mixture.select(*keys), keys, "left_anti")
        .distinct()
    )
    return found.unionByName(lone, allowMissingColumns=True)


def block_violations(
    mixture: DataFrame, stems: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS
) -> DataFrame:
    """Blocks that some side has and the mixture or a required stem lacks."""
    wanted = F.array(*[F.lit(s) for s in ("mixture", *required)])
    return _block_sides(mixture, stems, required).select(
        "recording_id", "block_index", F.explode(F.array_except(wanted, "sides")).alias("side")
    ).select("recording_id", *TL.violation("separation", "missing_block", F.col("side"), F.col("block_index")))


def _complete(batch: pa.RecordBatch, row: int, required: tuple[str, ...]) -> bool:
    return all(batch.column(name)[row].is_valid for name in ("mixture", *required))


def _block_arrays(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return np.stack(_channels(batch.column(name)[row]))


def residual_blocks(
    mixture: DataFrame, stems: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS
) -> DataFrame:
    """Mixture minus the sum of the stems, sample by sample; null for a block that a side lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residuals = []
            for row in range(batch.num_rows):
                if not _complete(batch, row, required):
                    residuals.append(None)
                    continue
                total = _block_arrays(batch, row, required[0]).copy()
                for stem in required[1:]:
                    total += _block_arrays(batch, row, stem)
                residuals.append(list(_block_arrays(batch, row, "mixture") - total))
            yield pa.RecordBatch.from_arrays(
                [batch.column("recording_id"), batch.column("block_index"), batch.column("start_sample"),
                 pa.array(residuals, pa.list_(pa.list_(pa.float32())))],
                names=["recording_id", "block_index", "start_sample", "residual"],
            )

    found = side_by_side(mixture, stems, required).mapInArrow(
        run,
        "recording_id string, block_index bigint, start_sample bigint, residual array<array<float>>",
    )
    return _with_lone_blocks(found, mixture, stems, required)


def block_energies(
    mixture: DataFrame, stems: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS
) -> DataFrame:
    """Per block: values counted, energies in double precision, peaks; null where a side lacks the block."""
    peaks = ", ".join(f"peak_{s} double" for s in required)
    names = [f"peak_{s}" for s in required]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                if not _complete(batch, row, required):
                    found.append((np.nan,) * (4 + len(required)))
                    continue
                whole = _block_arrays(batch, row, "mixture")
                total, peak = np.zeros_like(whole), []
                for stem in required:
                    part = _block_arrays(batch, row, stem)
                    total += part
                    peak.append(float(np.abs(part).max(initial=0.0)))
                rest = whole - total
                found.append((
                    float(whole.size),
                    float(np.square(whole, dtype=np.float64).sum()),
                    float(np.square(rest, dtype=np.float64).sum()),
                    float(np.abs(rest).max(initial=0.0)),
                    *peak,
                ))
            columns = np.array(found, dtype=np.float64).reshape(batch.num_rows, 4 + len(required))
            lacking = np.array([not _complete(batch, row, required) for row in range(batch.num_rows)], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("recording_id"), batch.column("block_index")]
                + [pa.array(columns[:, i], mask=lacking) for i in range(columns.shape[1])],
                names=["recording_id", "block_index", "values", "mixture_energy", "residual_energy",
                       "max_residual", *names],
            )

    found = side_by_side(mixture, stems, required).mapInArrow(
        run,
        "recording_id string, block_index bigint, values double, mixture_energy double, "
        f"residual_energy double, max_residual double, {peaks}",
    )
    return _with_lone_blocks(found, mixture, stems, required)


def reconstruction_metrics(energies: DataFrame, config: SeparationConfig = SeparationConfig()) -> DataFrame:
    """RMS, normalised error, signal-to-noise ratio and peaks per recording.

    A recording of which a side lacks a block has nulls: what is left says nothing about the whole.
    """
    whole = F.count("values") == F.count(F.lit(1))
    over = lambda value: F.when(whole, value)
    per_recording = energies.groupBy("recording_id").agg(
        over(F.sqrt(F.sum("mixture_energy") / F.sum("values"))).alias("mixture_rms"),
        over(F.sqrt(F.sum("residual_energy") / F.sum("values"))).alias("residual_rms"),
        over(F.max("max_residual")).alias("maximum_absolute_residual"),
        *[over(F.max(f"peak_{s}")).alias(f"peak_{s}") for s in config.required_stems],
    )
    loudness = F.when(F.col("mixture_rms").isNotNull(), F.greatest(F.col("mixture_rms"), F.lit(X.DOUBLE_EPSILON)))
    return (
        per_recording.withColumn("normalized_reconstruction_error", F.col("residual_rms") / loudness)
        .withColumn(
            "reconstruction_snr_db",
            F.when(F.col("residual_rms") == 0, F.lit(float("inf"))).otherwise(
                20.0 * F.log10(F.try_divide(loudness, F.col("residual_rms")))
            ),
        )
        .withColumn("threshold", F.lit(config.maximum_error))
        .withColumn(
            "within_threshold", F.col("normalized_reconstruction_error") <= F.lit(config.maximum_error)
        )
    )


def quality_violations(metrics: DataFrame) -> DataFrame:
    """Reconstructions above the error threshold, as warnings."""
    return metrics.filter(~F.col("within_threshold")).select(
        "recording_id",
        *TL.violation(
            "separation", "above_threshold", "reconstruction",
            F.col("normalized_reconstruction_error"), "warn",
        ),
    )


@dataclass(frozen=True)
class SeparationAudit:
    metrics: DataFrame
    violations: DataFrame


def audit_separation(
    mixture: DataFrame,
    stem_blocks: DataFrame,
    mixtures: DataFrame,
    stems: DataFrame,
    config: SeparationConfig = SeparationConfig(),
) -> SeparationAudit:
    """Contract, alignment, blocks of every side and reconstruction quality.

    Recordings that break the contract or the alignment, or of which a side lacks a block, have
    violations and no metrics.
    """
    broken = contract_violations(mixtures, stems, config.required_stems).unionByName(
        alignment_violations(mixtures, stems)
    )
    failing = broken.select("recording_id").distinct()
    sound = mixture.join(failing, "recording_id", "left_anti")
    sound_stems = stem_blocks.join(failing, "recording_id", "left_anti")
    broken = broken.unionByName(block_violations(sound, sound_stems, config.required_stems))
    metrics = reconstruction_metrics(block_energies(sound, sound_stems, config.required_stems), config)
    metrics = metrics.filter(F.col("mixture_rms").isNotNull())
    return SeparationAudit(metrics, broken.unionByName(quality_violations(metrics)))


def loudness(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and unbiased deviation of sample rows; a silent key has no usable deviation."""
    deviation = F.stddev_samp(value)
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("reference_mean"),
        F.when(deviation > 0, deviation).alias("reference_std"),
    )


def block_loudness(blocks: DataFrame) -> DataFrame:
    """Mean and unbiased deviation of the mono reference of each track, merged from block moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moments = []
            for row in range(batch.num_rows):
                mono = _block_arrays(batch, row, "samples").mean(axis=0, dtype=np.float32).astype(np.float64)
                mean = mono.mean() if mono.size else 0.0
                moments.append((float(mono.size), mean, float(np.square(mono - mean).sum())))
            grid = np.array(moments, dtype=np.float64).reshape(batch.num_rows, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("recording_id"), batch.column("track"), *[pa.array(grid[:, i]) for i in range(3)]],
                names=["recording_id", "track", "n", "mean", "m2"],
            )

    moments = blocks.select("recording_id", "track", "samples").mapInArrow(
        run, "recording_id string, track string, n double, mean double, m2 double"
    )
    merged = moments.groupBy("recording_id", "track").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss"),
        F.sum("m2").alias("m2"),
    )
    mean = F.try_divide("s", "n")
    variance = F.try_divide(F.col("m2") + F.col("ss") - F.col("n") * mean * mean, F.col("n") - 1)
    return merged.select(
        "recording_id",
        "track",
        mean.alias("reference_mean"),
        F.when(variance > 0, F.sqrt(variance)).alias("reference_std"),
    )


def normalised(value, mean="reference_mean", std="reference_std") -> Column:
    return (X._col(value) - X._col(mean)) / X._col(std)


def denormalised(value, mean="reference_mean", std="reference_std") -> Column:
    """Back to the original loudness, kept inside the open full scale."""
    return X.clamp(X._col(value) * X._col(std) + X._col(mean), -CLAMP, CLAMP)


def normalise_blocks(blocks: DataFrame, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """Normalise every sample with its track's loudness, or undo that."""
    formula = denormalised if inverse else normalised
    joined = attach(blocks, stats, ["recording_id", "track"], "block_index")
    return joined.withColumn(
        "samples",
        F.transform(
            "samples",
            lambda c: F.transform(c, lambda x: formula(x.cast("double")).cast("float")),
        ),
    ).select(*blocks.columns)


def stem_records(stem_files: DataFrame, peaks: DataFrame, required: tuple[str, ...] = REQUIRED_STEMS) -> DataFrame:
    """The stem table: file facts joined with the peak amplitude found by the audit."""
    tall = peaks.select(
        "recording_id",
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("stem"), F.col(f"peak_{s}").alias("peak_absolute_amplitude"))
            for s in required
        ])),
    )
    return stem_files.withColumn(
        "duration_seconds", F.round(F.col("frame_count") / F.col("sample_rate_hz"), 9)
    ).join(tall, ["recording_id", "stem"], "left")


def run_backend(mixture: DataFrame, backend: Backend, identity: dict[str, str]) -> DataFrame:
    """Stem blocks from a backend, each row naming the backend that made it."""
    fields = [F.lit(value).alias(name) for name, value in sorted(identity.items())]
    return backend(mixture).withColumn("backend", F.struct(*fields))


def even_split_backend(required: tuple[str, ...] = REQUIRED_STEMS) -> Backend:
    """A backend for tests: every stem is an equal share of the mixture."""

    def separate(mixture: DataFrame) -> DataFrame:
        share = float(len(required))
        scaled = lambda name: F.transform(
            name, lambda c: F.transform(c, lambda x: (x / F.lit(share)).cast("float"))
        )
        parts = [
            mixture.withColumn("track", F.lit(stem)).withColumns(
                {name: scaled(name) for name in ("before", "samples", "after")}
            )
            for stem in required
        ]
        return reduce(DataFrame.unionByName, parts)

    return separate
