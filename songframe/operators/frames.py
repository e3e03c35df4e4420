"""Spectral frames and log-band features cut from waveform blocks.

A block row carries the samples around it, so every frame is computed where its block lies and
nothing is shuffled. ``with_context`` adds the surroundings to blocks that were stored without.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe import schemas
from songframe.functions import exprs as X
from songframe.functions import signal as S
from songframe.operators import timeline as TL
from songframe.operators.ordered import with_previous

# Rows are flushed to Spark once this many float values are waiting.
FLUSH_VALUES = 1 << 20
# Or this many blocks: of short blocks the arrays themselves take far more memory than their values.
FLUSH_PARTS = 1 << 9
# Fixed value: the order in which stem features are stacked.
STEM_ORDER = ("bass", "drums", "other", "vocals")
ONSET_FRAME = 2_048
ONSET_HOP = 512
ONSET_FLOOR_DB = -80.0


@dataclass(frozen=True)
class SpectrogramConfig:
    name: str
    n_fft: int
    hop_length: int
    window: str = "hann"
    minimum_db: float = -120.0


# The two default resolutions.
DEFAULT_CONFIGS = (
    SpectrogramConfig("transient", 1_024, 256),
    SpectrogramConfig("harmonic", 4_096, 1_024),
)


def reblocked(blocks: DataFrame, size: int = schemas.BLOCK_SAMPLES) -> DataFrame:
    """The same samples in blocks of ``size``, whatever lengths they came in.

    Each piece goes to the block it falls in; a block collects at most ``size`` samples.
    """
    first, last = F.floor(F.col("start_sample") / size), F.floor((F.col("start_sample") + F.size(F.get("samples", F.lit(0))) - 1) / size)
    cut = blocks.filter(F.size(F.get("samples", F.lit(0))) > 0).withColumn("__block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("__block") * size - F.col("start_sample"), F.lit(0))
    end = F.least((F.col("__block") + 1) * size - F.col("start_sample"), F.size(F.get("samples", F.lit(0))).cast("long"))
    cut = cut.withColumn("__start", F.col("start_sample") + begin)
    cut = cut.withColumn("samples", F.transform("samples", lambda c: F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int"))))
    others = [c for c in blocks.columns if c not in ("recording_id", "track", "block_index", "start_sample", "samples", "before", "after")]
    parts = cut.groupBy("recording_id", "track", F.col("__block").cast("bigint").alias("block_index")).agg(
        F.min("__start").alias("start_sample"),
        F.sort_array(F.collect_list(F.struct("__start", "samples"))).alias("__parts"),
        *[F.first(c).alias(c) for c in others],
    )
    channels = F.size(F.get("__parts", F.lit(0))["samples"])
    joined = F.transform(F.sequence(F.lit(0), channels - 1), lambda i: F.flatten(F.transform("__parts", lambda p: F.get(p["samples"], i))))
    return parts.withColumn("samples", joined).select(*[c for c in blocks.columns if c not in ("before", "after")])


def _short_tracks(blocks: DataFrame, owed: int) -> DataFrame:
    """Tracks with a block, not their last, of fewer samples than the context it owes its neighbours."""
    length = F.size(F.coalesce(F.get("samples", F.lit(0)), F.array().cast("array<float>")))
    sizes = blocks.select("recording_id", "track", "block_index", length.alias("n"))
    last = sizes.groupBy("recording_id", "track").agg(F.max("block_index").alias("last"))
    return sizes.join(last, ["recording_id", "track"]).filter((F.col("n") < owed) & (F.col("block_index") < F.col("last"))).select("recording_id", "track").distinct()


def with_context(
    blocks: DataFrame, before: int = schemas.CONTEXT_BEFORE, after: int = schemas.CONTEXT_AFTER, size: int = schemas.BLOCK_SAMPLES
) -> DataFrame:
    """Add ``before`` and ``after`` samples taken from the neighbouring blocks.

    Only block edges travel to the neighbours; each block is moved once to meet them. A neighbour alone
    has to hold the whole context, so tracks with shorter blocks (the last may be short) are cut into
    blocks of ``size`` first; all others stay as they are.
    """
    owed = max(before, after)
    if size < owed:
        raise ValueError("a block has to hold the context it owes")
    keys = ["recording_id", "track", "block_index"]
    short = _short_tracks(blocks, owed)
    bare = blocks.drop("before", "after")
    blocks = bare.join(short, ["recording_id", "track"], "left_anti").unionByName(
        reblocked(bare.join(short, ["recording_id", "track"], "left_semi").select(*bare.columns), size), allowMissingColumns=True
    )
    tail = F.transform("samples", lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - F.lit(before) + 1), F.lit(before)))
    head = F.transform("samples", lambda c: F.slice(c, 1, after))
    none = F.lit(None).cast("array<array<float>>")
    edges = blocks.select(
        "recording_id",
        "track",
        F.explode(
            F.array(
                F.struct((F.col("block_index") + 1).alias("b"), tail.alias("t"), none.alias("h")),
                F.struct((F.col("block_index") - 1).alias("b"), none.alias("t"), head.alias("h")),
            )
        ).alias("edge"),
    ).groupBy("recording_id", "track", F.col("edge.b").alias("block_index")).agg(
        F.first("edge.t", ignorenulls=True).alias("before"),
        F.first("edge.h", ignorenulls=True).alias("after"),
    )
    silent = F.transform("samples", lambda c: F.slice(c, 1, 0))
    return (
        blocks.join(edges, keys, "left")
        .withColumn("before", F.coalesce("before", silent))
        .withColumn("after", F.coalesce("after", silent))
    )


def rate_violations(blocks: DataFrame, rate: int = S.BAND_RATE) -> DataFrame:
    """Tracks whose sample rate the log-band features are not made for; they get no features."""
    foreign = blocks.filter(~F.col("sample_rate_hz").eqNullSafe(F.lit(rate))).select("recording_id", "track", "sample_rate_hz").distinct()
    return foreign.select("recording_id", *TL.violation("features", "sample_rate", F.col("track"), F.col("sample_rate_hz")))


def _check_reach(before: int, after: int) -> None:
    """Centred frames must lie within a block and its context, or samples would count as zero unnoticed."""
    if before > schemas.CONTEXT_BEFORE or after > schemas.CONTEXT_AFTER:
        raise ValueError(f"frames that reach {before} back and {after} ahead need wider block context")


def _channels(cell) -> list[np.ndarray]:
    return [np.asarray(c.values.to_numpy(zero_copy_only=False), dtype=np.float32) for c in cell]


class _Block:
    """One block row, downmixed, with absolute sample positions."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(name)[row]
        self.recording_id = value("recording_id").as_py()
        self.track = value("track").as_py()
        self.rate = value("sample_rate_hz").as_py()
        self.start = value("start_sample").as_py()
        core = S.mono(_channels(value("samples")))
        before = [c for c in _channels(value("before")) if c.size]
        after = [c for c in _channels(value("after")) if c.size]
        parts = ([S.mono(before)] if before else []) + [core] + ([S.mono(after)] if after else [])
        self.signal = np.concatenate(parts) if len(parts) > 1 else core
        self.length = core.size
        self.origin = self.start - (parts[0].size if before else 0)
        self.end = self.start + self.length
        self.is_last = not after
        self.available = self.origin + self.signal.size


class _Rows:
    """Collects equally shaped rows and hands them out as record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.parts: list[list] = []
        self.values = 0

    def add(self, columns: list, values: int) -> None:
        self.parts.append(columns)
        self.values += values

    def full(self) -> bool:
        return self.values >= FLUSH_VALUES or len(self.parts) >= FLUSH_PARTS

    def take(self) -> pa.RecordBatch:
        arrays = [
            pa.concat_arrays([part[i].cast(field.type) for part in self.parts])
            for i, field in enumerate(self.schema)
        ]
        self.parts, self.values = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, np.float32).ravel()))


def _text(value: str, rows: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), rows)


def _map_blocks(blocks: DataFrame, kernel, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(arrow)
        for batch in batches:
            for row in range(batch.num_rows):
                for columns, values in kernel(_Block(batch, row)):
                    rows.add(columns, values)
                if rows.full():
                    yield rows.take()
        if rows.parts:
            yield rows.take()

    needed = [
        "recording_id", "track", "start_sample", "sample_rate_hz", "before", "samples", "after",
    ]
    return blocks.select(*needed).mapInArrow(run, schema)


def spectrogram_frames(
    blocks: DataFrame,
    configs: Iterable[SpectrogramConfig] = DEFAULT_CONFIGS,
    decibels: bool = True,
    precise: bool = False,
) -> DataFrame:
    """Level of every STFT frame of every track, for each configuration.

    A frame belongs to the block that holds its first sample. Only frames that fit are made.
    ``precise`` computes in double precision; results are stored in single precision either way.
    """
    configs = tuple(configs)
    for config in configs:
        if config.n_fft > schemas.CONTEXT_AFTER:
            raise ValueError(f"n_fft above {schemas.CONTEXT_AFTER} needs wider block context")
        if config.window != "hann":
            raise ValueError("only the hann window is available")
    dtype = np.float64 if precise else np.float32
    windows = {c.name: S.periodic_hann(c.n_fft, dtype) for c in configs}

    def kernel(block: _Block):
        for c in configs:
            first = -(-block.start // c.hop_length)
            in_block = -(-block.end // c.hop_length)
            fitting = (block.available - c.n_fft) // c.hop_length + 1
            count = min(in_block, fitting) - first
            if count <= 0:
                continue
            frames = S.cut_frames(
                block.signal, block.origin, first * c.hop_length, count, c.hop_length, c.n_fft
            )
            window = windows[c.name]
            level = S.magnitude(frames, window, 1.0 / float(window.sum(dtype=np.float64)))
            if decibels:
                level = S.level_db(level, c.minimum_db)
            index = np.arange(first, first + count, dtype=np.int64)
            center = (c.n_fft / 2 + index * c.hop_length) / float(block.rate)
            yield [
                _text(block.recording_id, count), _text(block.track, count), _text(c.name, count),
                pa.array(index), pa.array(center), _lists(level),
            ], level.size

    arrow = pa.schema([
        ("recording_id", pa.string()), ("track", pa.string()), ("config", pa.string()),
        ("frame_index", pa.int64()), ("center_seconds", pa.float64()),
        ("magnitude_dbfs", pa.list_(pa.float32())),
    ])
    return _map_blocks(blocks, kernel, schemas.SPECTROGRAM_FRAMES, arrow)


def log_band_frames(
    blocks: DataFrame,
    frame: int = S.BAND_FRAME,
    hop: int = S.BAND_HOP,
    rate: int = S.BAND_RATE,
    low_hz: float = S.BAND_LOW_HZ,
    high_hz: float = S.BAND_HIGH_HZ,
    precise: bool = False,
) -> DataFrame:
    """Log-compressed band energies on a regular grid, one frame centred at every hop.

    Frames reach past both ends of the recording, where samples count as zero. Tracks of another
    rate give no frames; ``rate_violations`` lists them.
    """
    _check_reach(frame // 2, frame - frame // 2)
    blocks = blocks.filter(F.col("sample_rate_hz") == rate)
    dtype = np.float64 if precise else np.float32
    window = S.symmetric_hann(frame, dtype)
    filters = S.log_filterbank(frame, rate, low_hz, high_hz).astype(dtype)

    def kernel(block: _Block):
        first = -(-block.start // hop)
        count = -(-block.end // hop) - first
        if count <= 0:
            return
        cut = S.cut_frames(block.signal, block.origin, first * hop - frame // 2, count, hop, frame)
        bands = np.log10(1.0 + S.magnitude(cut, window)[:, : frame // 2] @ filters)
        index = np.arange(first, first + count, dtype=np.int64)
        yield [
            _text(block.recording_id, count), _text(block.track, count), pa.array(index),
            _lists(bands),
        ], bands.size

    arrow = pa.schema([
        ("recording_id", pa.string()), ("track", pa.string()), ("frame_index", pa.int64()),
        ("bands", pa.list_(pa.float32())),
    ])
    return _map_blocks(blocks, kernel, schemas.LOG_BAND_FRAMES, arrow)


def onset_chroma_frames(
    blocks: DataFrame, frame: int = ONSET_FRAME, hop: int = ONSET_HOP
) -> DataFrame:
    """Onset strength and pitch-class profile of centred frames, without a shuffle.

    Onset strength is the mean positive level change from the frame before. The profile is scaled
    to a maximum of one; a silent frame stays zero.
    """
    _check_reach(frame // 2 + hop, frame - frame // 2 + hop)
    window = S.periodic_hann(frame)
    scale = 1.0 / float(window.sum(dtype=np.float64))

    def kernel(block: _Block):
        first = -(-block.start // hop)
        stop = -(-block.end // hop)
        if block.is_last and block.end % hop == 0:
            stop += 1
        count = stop - first
        if count <= 0:
            return
        lead = 1 if first > 0 else 0
        cut = S.cut_frames(
            block.signal, block.origin, (first - lead) * hop - frame // 2, count + lead, hop, frame
        )
        level = S.magnitude(cut, window, scale)
        decibels = S.level_db(level, ONSET_FLOOR_DB)
        change = np.maximum(np.diff(decibels, axis=0), 0.0).mean(axis=1)
        onset = change if lead else np.concatenate([np.zeros(1, np.float32), change])
        chroma = level[lead:] @ S.chroma_map(frame, block.rate)
        peak = chroma.max(axis=1, keepdims=True)
        chroma = np.divide(chroma, peak, out=np.zeros_like(chroma), where=peak > 0)
        index = np.arange(first, stop, dtype=np.int64)
        yield [
            _text(block.recording_id, count), _text(block.track, count), pa.array(index),
            pa.array(index * hop / float(block.rate)), pa.array(onset.astype(np.float64)),
            _lists(chroma),
        ], chroma.size

    schema = (
        "recording_id string, track string, frame_index bigint, seconds double, onset double, "
        "chroma array<float>"
    )
    arrow = pa.schema([
        ("recording_id", pa.string()), ("track", pa.string()), ("frame_index", pa.int64()),
        ("seconds", pa.float64()), ("onset", pa.float64()), ("chroma", pa.list_(pa.float32())),
    ])
    return _map_blocks(blocks, kernel, schema, arrow)


def project_frames(frames: DataFrame, column: str, matrix: np.ndarray, output: str) -> DataFrame:
    """Multiply each frame's leading bins with a fixed matrix, next to the frame's other columns.

    The matrix is a constant of the configuration (1,024 by 81 at most in practice) and travels
    with the function.
    """
    bins = matrix.shape[0]
    kept = [f for f in frames.schema.fields if f.name != column]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            grid = flat.reshape(batch.num_rows, -1)[:, :bins] if batch.num_rows else np.zeros((0, bins))
            arrays = [batch.column(f.name) for f in kept] + [_lists(grid.astype(np.float64) @ matrix)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [output])

    return frames.mapInArrow(run, f"{ddl}, `{output}` array<float>")


def onset_from_frames(frames: DataFrame, vector: str = "magnitude_dbfs", run: int = 4_096) -> DataFrame:
    """Onset strength of stored level frames: the mean positive change from the frame before.

    For frames that are already in a table; ``onset_chroma_frames`` gets it from the audio without
    moving any spectrum.
    """
    keys = ["recording_id", "track", "config"]
    paired = with_previous(
        frames.select(*keys, "frame_index", vector), keys, "frame_index",
        F.floor(F.col("frame_index") / F.lit(run)), {"__previous": vector},
    )
    change = F.zip_with(vector, "__previous", lambda a, b: F.greatest((a - b).cast("double"), F.lit(0.0)))
    total = F.aggregate(change, F.lit(0.0), lambda acc, x: acc + x)
    return paired.select(
        *keys, "frame_index",
        F.when(F.col("__previous").isNull(), F.lit(0.0)).otherwise(total / F.size(vector)).alias("onset"),
    )


def framed(vector: str | Column, size: int, hop: int) -> Column:
    """Overlapping windows of a short array as an array of arrays, without padding."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    last = F.size(vector) - F.lit(size)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda s: F.slice(vector, s + 1, size))


def frequency_axis(n_fft: int, rate: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft // 2)), lambda k: (k * rate / n_fft).cast("float"))


def config_rows(configs: Iterable[SpectrogramConfig]) -> Column:
    """Configurations as an array of structs, for ``F.inline``."""
    return F.array(*[
        F.struct(
            F.lit(c.name).alias("config"),
            F.lit(c.n_fft).alias("n_fft"),
            F.lit(c.hop_length).alias("hop_length"),
            F.lit(c.window).alias("window"),
            F.lit(float(c.minimum_db)).alias("minimum_db"),
        )
        for c in configs
    ])


def spectrogram_meta(
    tracks: DataFrame, configs: Iterable[SpectrogramConfig] = DEFAULT_CONFIGS
) -> DataFrame:
    """Shape and lineage of every spectrogram, one row per (recording, track, configuration).

    ``tracks`` needs recording_id, track, sample_rate_hz, frame_count and sha256. Each track row is
    expanded in place by the list of configurations.
    """
    digest = X.config_digest(
        name="config", n_fft="n_fft", hop_length="hop_length", window="window", minimum_db="minimum_db"
    )
    frames = X.stft_frame_count("frame_count", "n_fft", "hop_length")
    center = lambda k: X.frame_center(k, "n_fft", "hop_length", "sample_rate_hz")
    return (
        tracks.select(
            "recording_id", "track", "sample_rate_hz", "frame_count", "sha256", F.inline(config_rows(configs))
        )
        .withColumn("time_frames", frames)
        .withColumn("config_sha256", digest)
        .select(
            "recording_id", "track", "config", "n_fft", "hop_length", "window", "minimum_db",
            "config_sha256", "sample_rate_hz",
            F.col("frame_count").alias("waveform_samples"),
            (F.floor(F.col("n_fft") / 2) + 1).cast("int").alias("frequency_bins"),
            "time_frames",
            F.when(F.col("time_frames") > 0, center(F.lit(0))).alias("first_frame_center_seconds"),
            F.when(F.col("time_frames") > 0, center(F.col("time_frames") - 1)).alias(
                "last_frame_center_seconds"
            ),
            F.col("sha256").alias("parent_sha256"),
        )
    )


def spectrogram_summary(frames: DataFrame) -> DataFrame:
    """Counts and extent measured on stored frames."""
    return frames.groupBy("recording_id", "track", "config").agg(
        F.count(F.lit(1)).alias("time_frames"),
        F.max(F.size("magnitude_dbfs")).alias("frequency_bins"),
        F.min("center_seconds").alias("first_frame_center_seconds"),
        F.max("center_seconds").alias("last_frame_center_seconds"),
    )


def short_recordings(meta: DataFrame) -> DataFrame:
    """Recordings too short for a window: no frames, one warning."""
    return meta.filter(F.col("time_frames") == 0).select(
        "recording_id",
        *TL.violation(
            "spectrogram", "shorter_than_window", F.concat_ws("/", "track", "config"),
            F.col("waveform_samples"), "warn",
        ),
    )


def stack_stems(bands: DataFrame, order: tuple[str, ...] = STEM_ORDER) -> DataFrame:
    """The stems' feature frames side by side in fixed order, one row per (recording, frame).

    Recordings whose stems have different frame counts are left to ``stem_shape_violations``.
    """
    chosen = bands.filter(F.col("track").isin(*order)).groupBy("recording_id", "frame_index").agg(
        *[F.max(F.when(F.col("track") == stem, F.col("bands"))).alias(f"__{i}") for i, stem in enumerate(order)]
    )
    complete = chosen
    for i in range(len(order)):
        complete = complete.filter(F.col(f"__{i}").isNotNull())
    return complete.select(
        "recording_id", "frame_index", F.array(*[F.col(f"__{i}") for i in range(len(order))]).alias("stems")
    )


def feature_shapes(bands: DataFrame, order: tuple[str, ...] = STEM_ORDER) -> DataFrame:
    """(stems, frames, bands) per recording, with the number of different stem shapes."""
    per_stem = bands.filter(F.col("track").isin(*order)).groupBy("recording_id", "track").agg(
        F.count(F.lit(1)).alias("frames"), F.max(F.size("bands")).alias("bands")
    )
    return per_stem.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("stems"),
        F.max("frames").alias("frames"),
        F.max("bands").alias("bands"),
        F.count_distinct("frames", "bands").alias("shapes"),
    )


def stem_shape_violations(
    shapes: DataFrame, recordings: DataFrame, stems: int = 4, hop: int = S.BAND_HOP,
    bands: int = S.BAND_COUNT,
) -> DataFrame:
    """Feature tensors that are not ``stems`` x ceil(samples / hop) x ``bands``."""
    expected = F.ceil(F.col("frame_count") / F.lit(hop)).cast("bigint")
    got = F.concat_ws("x", "stems", "frames", "bands")
    want = F.concat_ws("x", F.lit(stems), expected, F.lit(bands))
    return (
        recordings.select("recording_id", "frame_count")
        .join(shapes, "recording_id")
        .filter((got != want) | (F.col("shapes") != 1))
        .select(
            "recording_id",
            *TL.violation("features", "shape_mismatch", "learned_input", F.concat(got, F.lit(" != "), want)),
        )
    )
