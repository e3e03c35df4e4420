"""Silent, clipped and truncated recordings, found on blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.operators import timeline as TL
from songframe.operators.ordered import with_previous, with_running_max

SILENCE = 1e-4
FULL_SCALE = 0.999
# Seconds of silence in one stretch, and samples in a row at full scale, that make a recording suspect.
SILENT_SECONDS = 10.0
CLIPPED_SAMPLES = 8
# Blocks of a recording that one window of the ordered pass sees.
RUN_BLOCKS = 1_024

_KINDS = ("silent", "clipped")
_SUMMARY = "length bigint, " + ", ".join(f"{k}_total bigint, {k}_head bigint, {k}_tail bigint, {k}_best bigint" for k in _KINDS)


def run_summary(flags: np.ndarray) -> tuple[int, int, int, int]:
    """How many are set, how many in a row at the start, at the end, and at most."""
    n = len(flags)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0, 0, 0
    lengths = stops - starts
    return int(lengths.sum()), int(stops[0]) if starts[0] == 0 else 0, int(n - starts[-1]) if stops[-1] == n else 0, int(lengths.max())


def _summaries(silence: float, full_scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for samples in batch.column("samples"):
                channels = [] if samples.values is None else [np.abs(c.values.to_numpy(zero_copy_only=False)) if c.values is not None else np.zeros(0) for c in samples.values]
                size = min((len(c) for c in channels), default=0)
                loud = np.stack([c[:size] for c in channels]) if channels else np.zeros((1, 0))
                found.append((size, *run_summary((loud <= silence).all(0)), *run_summary((loud >= full_scale).any(0))))
            columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(9)]
            names = ["recording_id", "track", "block_index", "start_sample", "sample_rate_hz"]
            summary = ["length", *(f"{k}_{part}" for k in _KINDS for part in ("total", "head", "tail", "best"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *summary])

    return run


def recording_defects(blocks: DataFrame, silence: float = SILENCE, full_scale: float = FULL_SCALE) -> DataFrame:
    """Per recording and track: samples, gaps between blocks, and counts and longest runs of silent and clipped ones.

    A sample is silent if no channel is above ``silence`` and clipped if one reaches ``full_scale``. A
    block is reduced to its runs: at its start, at its end, the longest. Runs that reach over blocks
    begin where the last block that is not one whole run let go of the end, which a running maximum
    over sample positions gives, so no recording has to fit in a task. A missing block ends a run. Null or
    empty blocks have no samples.
    """
    schema = "recording_id string, track string, block_index bigint, start_sample bigint, sample_rate_hz int, " + _SUMMARY
    rows = blocks.select(
        F.col("recording_id").cast("string"), "track", F.col("block_index").cast("bigint"), F.col("start_sample").cast("bigint"),
        F.col("sample_rate_hz").cast("int"), F.coalesce("samples", F.array().cast("array<array<float>>")).alias("samples"),
    ).mapInArrow(_summaries(silence, full_scale), schema).withColumn("end_sample", F.col("start_sample") + F.col("length"))
    keys, order, run = ["recording_id", "track"], "block_index", F.floor(F.col("block_index") / RUN_BLOCKS)
    rows = with_previous(rows, keys, order, run, {"__ended": "end_sample"})
    gap = F.col("__ended").isNotNull() & (F.col("__ended") < F.col("start_sample"))
    fresh = gap | F.col("__ended").isNull()
    for kind in _KINDS:
        # where a run that touches the block's end begins, unless the whole block is one
        loose = F.when(F.col(f"{kind}_head") < F.col("length"), F.col("end_sample") - F.col(f"{kind}_tail"))
        rows = with_running_max(rows, keys, order, run, loose, f"__{kind}_before")
        rows = rows.withColumn(f"__{kind}_fresh", F.when(fresh, F.col("start_sample")))
        rows = with_running_max(rows, keys, order, run, F.col(f"__{kind}_fresh"), f"__{kind}_gap")
        begin = F.greatest(F.coalesce(f"__{kind}_fresh", f"__{kind}_gap"), F.col(f"__{kind}_before"))
        through = F.when(F.col(f"{kind}_head") > 0, F.col("start_sample") + F.col(f"{kind}_head") - F.when(fresh, F.col("start_sample")).otherwise(begin))
        rows = rows.withColumn(f"{kind}_run", F.greatest(F.coalesce(through, F.lit(0)), F.col(f"{kind}_best")))
    return rows.groupBy(*keys).agg(
        F.sum("length").alias("samples"), F.max("end_sample").alias("end_sample"), F.max("sample_rate_hz").alias("sample_rate_hz"),
        F.sum(F.when(gap | (F.col("__ended").isNull() & (F.col("start_sample") > 0)), 1).otherwise(0)).cast("bigint").alias("gaps"),
        *(f for k in _KINDS for f in (F.sum(f"{k}_total").alias(f"{k}_samples"), F.max(f"{k}_run").alias(f"{k}_run"))),
    )


def defect_violations(
    defects: DataFrame, recordings: DataFrame, silent_seconds: float = SILENT_SECONDS, clipped_samples: int = CLIPPED_SAMPLES
) -> DataFrame:
    """Recordings that are silent, hold a long silence, are clipped, lack blocks, or end before their length.

    ``recordings`` needs recording_id and frame_count. A recording without any block counts as truncated.
    """
    known = recordings.select("recording_id", F.col("frame_count").cast("bigint").alias("__frames")).join(defects, "recording_id", "left")
    run = F.col("silent_run") / F.col("sample_rate_hz")
    checks = {
        "silent": (F.col("silent_samples") == F.col("samples"), F.col("samples")),
        "long_silence": ((F.col("silent_samples") < F.col("samples")) & (run >= silent_seconds), run),
        "clipped": (F.col("clipped_run") >= clipped_samples, F.col("clipped_run")),
        "missing_blocks": (F.col("gaps") > 0, F.col("gaps")),
        "truncated": (F.coalesce("end_sample", F.lit(0)) < F.col("__frames"), F.coalesce("end_sample", F.lit(0))),
    }
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"))) for name, (bad, detail) in checks.items()
    ]))
    listed = known.select("recording_id", "track", F.inline(found))
    return listed.select("recording_id", *TL.violation("waveform", F.col("check"), F.coalesce("track", F.lit("mixture")), F.col("detail")))
