"""Configuration and geometry rules as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X


def broken_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (key, rule) that does not hold; a null outcome counts as broken."""
    failed = F.filter(
        F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]),
        lambda r: r.isNotNull(),
    )
    return df.select(*keys, F.explode(failed).alias("rule"))


def canonical_rules() -> dict[str, Column]:
    return {
        "sample_rate_positive": F.col("sample_rate_hz") > 0,
        "one_or_two_channels": F.col("channels").isin(1, 2),
        "pcm_24_bit": (F.col("codec") == "pcm_s24le") & (F.col("sample_width_bytes") == 3),
    }


def spectrogram_rules() -> dict[str, Column]:
    return {
        "name_path_safe": (F.length("name") > 0) & (F.instr("name", "/") == 0) & (F.instr("name", "\\") == 0),
        "n_fft_power_of_two": X.is_power_of_two("n_fft"),
        "hop_in_window": (F.col("hop_length") > 0) & (F.col("hop_length") <= F.col("n_fft")),
        "minimum_db_negative": F.col("minimum_db") < 0,
    }


def separation_rules() -> dict[str, Column]:
    stems = F.col("required_stems")
    return {
        "stems_unique_nonempty": (F.size(stems) > 0) & (F.size(F.array_distinct(stems)) == F.size(stems)),
        "error_limit_positive": F.col("maximum_error") > 0,
    }


def passage_rules() -> dict[str, Column]:
    return {
        "beats_positive": F.col("beats_per_passage") > 0,
        "minimum_positive": F.col("minimum_seconds") > 0,
    }


def geometry_mismatches(
    df: DataFrame, keys: list[str], expected: dict[str, Column], actual: dict[str, Column]
) -> DataFrame:
    """(key, property, expected, actual) wherever a property differs from what was asked for."""
    pairs = F.array(*[
        F.struct(
            F.lit(name).alias("property"),
            expected[name].cast("string").alias("expected"),
            actual[name].cast("string").alias("actual"),
        )
        for name in expected
    ])
    return df.select(*keys, F.inline(pairs)).filter(~F.col("expected").eqNullSafe(F.col("actual")))


def canonical_mismatches(geometry: DataFrame, rate: int = 44_100, channels: int = 2, width: int = 3) -> DataFrame:
    """Recordings whose wave is not in the canonical form."""
    expected = {
        "channels": F.lit(channels), "sample_rate_hz": F.lit(rate),
        "sample_width_bytes": F.lit(width), "compression_type": F.lit("NONE"),
    }
    return geometry_mismatches(geometry, ["recording_id"], expected, {k: F.col(k) for k in expected})


def separator_mismatches(mixtures: DataFrame, rate: int, channels: int) -> DataFrame:
    """Recordings a separator with this rate and channel count cannot take."""
    expected = {"sample_rate_hz": F.lit(rate), "channels": F.lit(channels)}
    return geometry_mismatches(mixtures, ["recording_id"], expected, {k: F.col(k) for k in expected})
