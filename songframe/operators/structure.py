"""Song structure: checked and aligned hypotheses, and an unsupervised baseline."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.operators.beats import best_beats
from songframe.operators.frames import ONSET_HOP, onset_chroma_frames
from songframe.operators.joins import attach
from songframe.operators.learned import section_distributions
from songframe.operators.ordered import with_position
from songframe.session import cut_lineage, spread

BEATS_PER_BAR = 4
PITCH_CLASSES = 12
TARGET_SECTION_SECONDS = 20.0
HYPOTHESIS = "baseline"
LABEL_KIND = "unsupervised_similarity_group"

# Lag products are summed in windows of this many frames (about 12 minutes at 512-sample hops), each
# with the context of the longest lag.
WINDOW_FRAMES = 65_536
WINDOW_CONTEXT = 1_024
SLOWEST_BPM = 30.0
FASTEST_BPM = 300.0
PREFERRED_BPM = 120.0

# Segmentation sees at most this many cells per recording. Up to that many frames a cell is one
# frame; longer recordings average neighbouring frames.
MAX_CELLS = 65_536

KEYS = ["recording_id", "hypothesis_id"]


@dataclass(frozen=True)
class Hypothesis:
    structures: DataFrame
    beats: DataFrame
    sections: DataFrame


# A structure backend turns waveform blocks into a hypothesis.
Backend = Callable[[DataFrame], Hypothesis]


@dataclass(frozen=True)
class Aligned:
    structures: DataFrame
    beats: DataFrame
    sections: DataFrame
    violations: DataFrame


def align_structure(
    hypothesis: Hypothesis, recordings: DataFrame, meta: DataFrame | None = None
) -> Aligned:
    """Check a backend's output and place its sections on samples and frames.

    ``recordings`` needs recording_id, sample_rate_hz, frame_count and duration_seconds. Nothing a
    backend returns is trusted; what does not hold becomes violation rows.
    """
    durations = hypothesis.structures.select(*KEYS).join(
        recordings.select("recording_id", "duration_seconds"), "recording_id"
    )
    downbeats = with_position(
        hypothesis.beats.filter("is_downbeat").select(*KEYS, "beat_index", "seconds"),
        KEYS, "beat_index", F.floor(F.col("beat_index") / TL.RUN), "downbeat_index",
    )
    violations = (
        TL.order_violations(hypothesis.beats, durations, KEYS, "beat_index", "seconds", "beats")
        .unionByName(TL.order_violations(downbeats, durations, KEYS, "downbeat_index", "seconds", "downbeats"))
        .unionByName(
            TL.contiguity_violations(hypothesis.sections, durations, KEYS, "section_index", "structure")
        )
    )
    sections = TL.align_intervals(hypothesis.sections, recordings, meta, "section_index")
    return Aligned(hypothesis.structures, hypothesis.beats, sections, violations)


def _windows(frames: DataFrame) -> DataFrame:
    """List each frame under its window and, near an edge, under the neighbouring window too."""
    window = lambda shift: F.floor((F.col("frame_index") + F.lit(shift)) / F.lit(WINDOW_FRAMES))
    own = F.array_distinct(F.array(window(-WINDOW_CONTEXT), window(0), window(WINDOW_CONTEXT)))
    return frames.withColumn("window", F.explode(own)).filter(F.col("window") >= 0)


def _lag_range(frame_rate: float) -> tuple[int, int]:
    return max(1, int(round(60.0 * frame_rate / FASTEST_BPM))), int(round(60.0 * frame_rate / SLOWEST_BPM))


def estimate_tempo(frames: DataFrame, frame_rate: float) -> DataFrame:
    """Tempo per recording from the autocorrelation of its onset strength.

    Lag products are summed inside windows and then over the windows of a recording, so the sum is
    the one over the whole recording. Tempi near 120 are preferred on an octave scale.
    """
    shortest, longest = _lag_range(frame_rate)

    lags = np.arange(shortest, longest + 1)

    def lag_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products = np.zeros((batch.num_rows, len(lags)))
            for row, (window, heard) in enumerate(zip(batch.column("window").to_pylist(), batch.column("heard"), strict=True)):
                frame, onset = (heard.values.field(c).to_numpy() for c in ("frame_index", "onset"))
                begin, stop = np.searchsorted(frame, [window * WINDOW_FRAMES, (window + 1) * WINDOW_FRAMES])
                for i, lag in enumerate(lags):
                    pairs = min(stop, len(onset) - lag) - begin
                    if pairs > 0:
                        products[row, i] = onset[begin : begin + pairs] @ onset[begin + lag : begin + lag + pairs]
            whole = batch.column("recording_id").take(pa.array(np.repeat(np.arange(batch.num_rows), len(lags))))
            yield pa.RecordBatch.from_arrays([whole, pa.array(np.tile(lags, batch.num_rows)), pa.array(products.ravel())], ["recording_id", "lag", "product"])

    sums = (
        spread(_windows(frames.select("recording_id", "frame_index", F.col("onset").cast("double").alias("onset"))), "recording_id", "window")
        .groupBy("recording_id", "window")
        .agg(F.array_sort(F.collect_list(F.struct("frame_index", "onset"))).alias("heard"))
        .mapInArrow(lag_products, "recording_id string, lag bigint, product double")
        .groupBy("recording_id", "lag")
        .agg(F.sum("product").alias("product"))
    )
    bpm = F.lit(60.0 * frame_rate) / F.col("lag")
    octaves = F.log2(bpm / F.lit(PREFERRED_BPM))
    score = F.col("product") * F.exp(-0.5 * octaves * octaves)
    return sums.groupBy("recording_id").agg(
        F.max_by("lag", F.struct(score, -F.col("lag"))).alias("period_frames"),
        F.max("product").alias("__strength"),
    ).select(
        "recording_id",
        F.when(F.col("__strength") > 0, F.col("period_frames")).alias("period_frames"),
        F.when(F.col("__strength") > 0, F.lit(60.0 * frame_rate) / F.col("period_frames")).alias("tempo_bpm"),
    )


def track_beats(frames: DataFrame, tempo: DataFrame, frame_rate: float) -> DataFrame:
    """Beats of every recording, numbered, with the onset strength they fall on."""
    raw = cut_lineage(best_beats(frames, tempo))
    placed = raw.join(frames.select("recording_id", "frame_index", "onset"), ["recording_id", "frame_index"])
    run = F.floor(F.col("frame_index") / WINDOW_FRAMES)
    numbered = with_position(
        placed.select("recording_id", "frame_index", "onset"), ["recording_id"], "frame_index", run, "beat_index"
    )
    return numbered.withColumn("seconds", F.col("frame_index") / F.lit(frame_rate))


def attach_onsets(beats: DataFrame, frames: DataFrame) -> DataFrame:
    """Onset strength at each beat's frame, the frame kept on the axis.

    ``beats`` needs recording_id and frame_index.
    """
    sizes = frames.groupBy("recording_id").agg((F.max("frame_index") + 1).alias("__frames"))
    placed = attach(beats, sizes, ["recording_id"], "frame_index", "inner").withColumn(
        "frame_index", X.clip_index("frame_index", "__frames")
    ).drop("__frames")
    return placed.join(
        frames.select("recording_id", "frame_index", "onset"), ["recording_id", "frame_index"], "left"
    )


def downbeat_phase(
    beats: DataFrame, keys: list[str], strength: str = "onset", per_bar: int = BEATS_PER_BAR
) -> DataFrame:
    """The offset within the bar whose beats are strongest; the lowest on a tie.

    A key with fewer beats than a bar has no phase. ``beats`` needs beat_index from zero.

    A sum of doubles depends on the order it is added in, which would decide ties. Strengths that are
    whole millionths below 10**12 are summed exactly and their means compared as quotient and rest; a
    key with any other strength is decided by means of doubles.
    """
    value = F.col(strength).cast("double")
    exact = value.try_cast("decimal(18,6)")
    scored = beats.groupBy(*keys, F.pmod("beat_index", F.lit(per_bar)).alias("__phase")).agg(
        F.avg(value).alias("__score"), F.count(F.lit(1)).alias("__n"),
        (F.sum(exact) * F.lit(1_000_000)).cast("decimal(38,0)").alias("__total"), F.nullif(F.count(value), F.lit(0)).alias("__count"),
        F.every(value.isNull() | F.coalesce(exact.cast("double") == value, F.lit(False))).alias("__exact"),
    ).withColumn("__whole", F.expr("__total div __count"))
    rest = (F.col("__total") - F.col("__whole") * F.col("__count")).cast("double") / F.col("__count")
    best = lambda *score: F.max_by("__phase", F.struct(*score, -F.col("__phase")))
    return scored.groupBy(*keys).agg(
        F.sum("__n").alias("__beats"),
        F.when(F.every("__exact"), best("__whole", rest)).otherwise(best("__score")).alias("__best"),
    ).select(*keys, F.when(F.col("__beats") >= per_bar, F.col("__best")).alias("downbeat_phase"))


def is_downbeat(phase: str = "downbeat_phase", per_bar: int = BEATS_PER_BAR):
    return F.coalesce(
        (F.col("beat_index") >= F.col(phase))
        & (F.pmod(F.col("beat_index") - F.col(phase), F.lit(per_bar)) == 0),
        F.lit(False),
    )


def mark_downbeats(
    beats: DataFrame, keys: list[str], strength: str = "onset", per_bar: int = BEATS_PER_BAR
) -> DataFrame:
    phases = downbeat_phase(beats, keys, strength, per_bar)
    return attach(beats, phases, keys, "beat_index").withColumn("is_downbeat", is_downbeat("downbeat_phase", per_bar))


def merge_neighbours(weights: np.ndarray, sums: np.ndarray, spans: int) -> np.ndarray:
    """Starts of ``spans`` runs of cells after merging the cheapest neighbours again and again.

    The price of a merge is the growth of the squared error around the means.
    """
    count = len(weights)
    weight, total = list(weights.astype(float)), list(sums.astype(float))
    following = list(range(1, count)) + [-1]
    preceding = list(range(-1, count - 1))
    version = [0] * count

    def price(a: int, b: int) -> float:
        gap = total[a] / weight[a] - total[b] / weight[b]
        return weight[a] * weight[b] / (weight[a] + weight[b]) * float(gap @ gap)

    queue = [(price(i, i + 1), i, 0, 0) for i in range(count - 1)]
    heapq.heapify(queue)
    alive = count
    while alive > spans and queue:
        _, a, version_a, version_b = heapq.heappop(queue)
        b = following[a]
        if b < 0 or version[a] != version_a or version[b] != version_b:
            continue
        weight[a] += weight[b]
        total[a] = total[a] + total[b]
        version[a] += 1
        version[b] = -1
        following[a] = following[b]
        if following[a] >= 0:
            preceding[following[a]] = a
            heapq.heappush(queue, (price(a, following[a]), a, version[a], version[following[a]]))
        before = preceding[a]
        if before >= 0:
            heapq.heappush(queue, (price(before, a), before, version[before], version[a]))
        alive -= 1
    return np.array([i for i in range(count) if version[i] >= 0], dtype=np.int64)


def segment_frames(frames: DataFrame, vector: str, size: int, spans: DataFrame) -> DataFrame:
    """(recording_id, frame_index) of the first frame of each span.

    ``spans`` has recording_id and span_count. At most ``MAX_CELLS`` cells per recording meet in
    one group; cells are formed by partial sums, and every frame counts.
    """
    sizes = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("__frames"))
    plan = sizes.join(spans, "recording_id").select(
        "recording_id", "span_count", F.ceil(F.col("__frames") / F.lit(MAX_CELLS)).alias("__width")
    )
    cells = (
        attach(frames.select("recording_id", "frame_index", vector), plan, ["recording_id"], "frame_index", "inner")
        .groupBy("recording_id", "span_count", F.floor(F.col("frame_index") / F.col("__width")).alias("cell"))
        .agg(
            F.min("frame_index").alias("frame_index"),
            F.count(F.lit(1)).alias("weight"),
            F.array(*[F.sum(F.get(vector, F.lit(i)).cast("double")) for i in range(size)]).alias("total"),
        )
    )

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        starts = merge_neighbours(
            rows["weight"].to_numpy(), np.stack(rows["total"].to_list()), int(rows["span_count"].iloc[0])
        )
        return pd.DataFrame({
            "recording_id": rows["recording_id"].iloc[0], "frame_index": rows["frame_index"].to_numpy()[starts],
        })

    return spread(cells, "recording_id").groupBy("recording_id").applyInPandas(
        cut, "recording_id string, frame_index bigint"
    )


def similar_groups(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Group numbers of a handful of vectors by repeated cheapest merge, numbered by appearance."""
    clusters = [([i], 1.0, vectors[i].astype(float)) for i in range(len(vectors))]
    while len(clusters) > groups:
        pairs = [
            (a[1] * b[1] / (a[1] + b[1]) * float(((a[2] / a[1] - b[2] / b[1]) ** 2).sum()), i, j)
            for i, a in enumerate(clusters)
            for j, b in enumerate(clusters[:i])
        ]
        _, i, j = min(pairs)
        a, b = clusters[i], clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)]
        clusters.append((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    numbers = np.zeros(len(vectors), dtype=np.int64)
    for number, cluster in enumerate(sorted(clusters, key=lambda c: min(c[0]))):
        numbers[cluster[0]] = number
    return numbers


def group_sections(sections: DataFrame, vector: str = "distribution") -> DataFrame:
    """Give each section the letter of its similarity group.

    A recording has at most 13 sections here: ``section_count`` allows 12 spans, plus the one
    that the recording's own end may add.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("section_index")
        wanted = min(4, max(1, round(float(np.sqrt(len(rows))))))
        numbers = similar_groups(np.stack(rows[vector].to_list()), wanted)
        return pd.DataFrame({
            "recording_id": rows["recording_id"], "section_index": rows["section_index"], "group": numbers,
        })

    numbered = sections.groupBy("recording_id").applyInPandas(
        assign, "recording_id string, section_index bigint, group bigint"
    )
    return numbered.withColumn("label", X.group_letter("group"))


def baseline_sections(frames: DataFrame, recordings: DataFrame, hop: int = ONSET_HOP) -> DataFrame:
    """Contiguous spans of similar harmony, labelled by similarity.

    ``recordings`` needs recording_id, sample_rate_hz and duration_seconds.
    """
    sizes = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("__frames"))
    known = recordings.select("recording_id", "sample_rate_hz", "duration_seconds")
    spans = sizes.join(known, "recording_id").select(
        "recording_id",
        X.section_count("duration_seconds", "__frames", TARGET_SECTION_SECONDS).alias("span_count"),
    )
    # A dozen rows per recording, read several times below.
    starts = cut_lineage(segment_frames(frames, "chroma", PITCH_CLASSES, spans))
    seconds = starts.join(known, "recording_id").select(
        "recording_id", X.frame_to_seconds("frame_index", F.lit(hop), "sample_rate_hz").alias("seconds")
    )
    boundaries = TL.boundary_set(seconds, known, ["recording_id"])
    # Twelve spans at most, so this numbering sees a dozen rows per recording.
    intervals = with_position(
        TL.intervals_between(boundaries, ["recording_id"], "seconds"),
        ["recording_id"], "start_seconds", F.lit(0), "section_index",
    )
    framed = attach(intervals, known.join(sizes, "recording_id"), ["recording_id"], "section_index").select(
        *intervals.columns,
        X.seconds_to_frame("start_seconds", F.lit(hop), "sample_rate_hz").alias("start_frame"),
        "__frames",
        X.seconds_to_frame("end_seconds", F.lit(hop), "sample_rate_hz").alias("__end"),
    ).withColumn(
        "end_frame", F.greatest(F.col("start_frame") + 1, F.least(F.col("__end"), F.col("__frames")))
    )
    means = section_distributions(
        frames.select("recording_id", F.col("frame_index").alias("frame"), "chroma"),
        framed.select("recording_id", "section_index", "start_frame", "end_frame"),
        ["recording_id"], "chroma", PITCH_CLASSES,
    )
    return intervals.join(group_sections(means), ["recording_id", "section_index"]).select(
        "recording_id",
        F.lit(HYPOTHESIS).alias("hypothesis_id"),
        "section_index",
        "start_seconds",
        "end_seconds",
        "label",
        F.lit(LABEL_KIND).alias("label_kind"),
    )


def baseline_structure(blocks: DataFrame, recordings: DataFrame, rate: int = 44_100) -> Hypothesis:
    """Tempo, beats, downbeats and sections of every mixture, without a trained model.

    The onset and chroma frames are read five times, so they are written to the checkpoint folder
    once instead of being cut from the audio again; they are about 1/40 of its size.
    """
    frame_rate = rate / ONSET_HOP
    frames = cut_lineage(onset_chroma_frames(blocks.filter(F.col("track") == "mixture")))
    tempo = cut_lineage(estimate_tempo(frames, frame_rate))
    beats = mark_downbeats(track_beats(frames, tempo, frame_rate), ["recording_id"])
    phases = beats.groupBy("recording_id").agg(F.max("downbeat_phase").alias("downbeat_phase"))
    structures = tempo.join(phases, "recording_id", "left").select(
        "recording_id", F.lit(HYPOTHESIS).alias("hypothesis_id"), "tempo_bpm", "downbeat_phase",
        F.lit("unsupervised-baseline").alias("backend"),
    )
    keyed = beats.select(
        "recording_id", F.lit(HYPOTHESIS).alias("hypothesis_id"), "beat_index", "seconds", "is_downbeat"
    )
    return Hypothesis(structures, keyed, baseline_sections(frames, recordings))
