"""The library's tables, derived from the driver's test tables.

There is no audio in the test data, so its tables play the parts: conversations are recordings
cut into sections, events are beats, onsets and stem samples, embeddings are short waveforms,
spectra or logits, documents are a catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import frames as FR
from songframe.operators.ordered import with_position, with_running_total
from songframe.session import tune

RATE = 44_100
# Event types that play the four stems; the fifth type is what the stems fail to explain.
STEM_OF_EVENT = {"purchase": "vocals", "click": "drums", "signup": "bass", "error": "other"}
# Days per block of the event waveforms.
BLOCK_DAYS = 8


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        """A table, opened once per query."""
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table


def event_micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def cents() -> Column:
    return F.rint(F.col("value") * 100).cast("bigint")


def sections(t: Tables) -> DataFrame:
    """Turns laid end to end, a tenth of a second per character."""
    turns = t.conversations.select(
        F.col("conv_id").cast("string").alias("recording_id"),
        F.lit("turns").alias("hypothesis_id"),
        F.col("turn").alias("section_index"),
        F.col("role").alias("label"),
        F.length("text").cast("bigint").alias("chars"),
    )
    laid = with_running_total(
        turns, ["recording_id", "hypothesis_id"], "section_index",
        F.floor(F.col("section_index") / 4_096), F.col("chars"), "ahead",
    )
    return laid.select(
        "recording_id", "hypothesis_id", "section_index",
        (F.col("ahead") / F.lit(10.0)).alias("start_seconds"),
        ((F.col("ahead") + F.col("chars")) / F.lit(10.0)).alias("end_seconds"),
        "label",
    )


def recordings(t: Tables) -> DataFrame:
    chars = t.conversations.groupBy("conv_id").agg(F.sum(F.length("text")).cast("bigint").alias("chars"))
    return chars.select(
        F.col("conv_id").cast("string").alias("recording_id"),
        (F.col("chars") / F.lit(10.0)).alias("duration_seconds"),
        F.lit(RATE).alias("sample_rate_hz"),
        (F.col("chars") * (RATE // 10)).alias("frame_count"),
    )


def beats(t: Tables) -> DataFrame:
    """Events of the user with the recording's number, folded onto the recording's length."""
    events = t.events.select(F.col("user_id").alias("conv_id"), event_micros().alias("us"))
    lengths = recordings(t).select(
        F.col("recording_id").cast("bigint").alias("conv_id"),
        F.rint(F.col("duration_seconds") * 1000).cast("bigint").alias("length_ms"),
    )
    return (
        events.join(lengths, "conv_id")
        .filter(F.col("length_ms") > 0)
        .select("conv_id", F.pmod(F.floor(F.col("us") / 1000).cast("bigint"), F.col("length_ms")).alias("ms"))
        .distinct()
        .select(
            F.col("conv_id").cast("string").alias("recording_id"),
            F.lit("turns").alias("hypothesis_id"),
            (F.col("ms") / F.lit(1000.0)).alias("seconds"),
        )
    )


def axes(t: Tables) -> DataFrame:
    tracks = recordings(t).select(
        "recording_id", F.lit("mixture").alias("track"), "sample_rate_hz", "frame_count",
        F.sha2("recording_id", 256).alias("sha256"),
    )
    return FR.spectrogram_meta(tracks)


def user_beats(t: Tables) -> DataFrame:
    """Each user's events in time order, in hours since the first of January."""
    placed = t.events.select(
        "user_id", "event_id", F.col("value").alias("onset"),
        ((event_micros() - F.lit(1_704_067_200_000_000)) / F.lit(3.6e9)).alias("seconds"),
    )
    return with_position(placed, ["user_id"], "seconds", F.floor(F.col("seconds") / 24), "beat_index")


def event_blocks(t: Tables) -> DataFrame:
    """Daily cents per user as waveform blocks of the mixture and its four stems."""
    day = F.floor((event_micros() - F.lit(1_704_067_200_000_000)) / F.lit(86_400_000_000)).cast("bigint")
    placed = t.events.select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.floor(day / BLOCK_DAYS).alias("block_index"),
        F.pmod(day, F.lit(BLOCK_DAYS)).alias("at"),
        "event_type",
        cents().alias("cents"),
    )
    tracks = {"mixture": F.lit(True), **{s: F.col("event_type") == e for e, s in STEM_OF_EVENT.items()}}
    grid = placed.groupBy("recording_id", "block_index").agg(*[
        F.array(*[
            F.coalesce(F.sum(F.when(chosen & (F.col("at") == i), F.col("cents"))), F.lit(0)).cast("float")
            for i in range(BLOCK_DAYS)
        ]).alias(track)
        for track, chosen in tracks.items()
    ])
    rows = F.array(*[
        F.struct(F.lit(track).alias("track"), F.array(F.col(track)).alias("samples")) for track in tracks
    ])
    silent = F.array(F.array().cast("array<float>"))
    return grid.select("recording_id", "block_index", F.inline(rows)).select(
        "recording_id", "track", "block_index",
        (F.col("block_index") * BLOCK_DAYS).alias("start_sample"),
        F.lit(RATE).alias("sample_rate_hz"),
        silent.alias("before"), "samples", silent.alias("after"),
    )


def vector_blocks(t: Tables, rate: int = RATE, recording: Column | None = None, track: Column | None = None) -> DataFrame:
    """Each embedding as a waveform of one block."""
    silent = F.array(F.array().cast("array<float>"))
    return t.embeddings.select(
        (F.col("vec_id") if recording is None else recording).cast("string").alias("recording_id"),
        (F.lit("mixture") if track is None else track).alias("track"),
        F.lit(0).cast("bigint").alias("block_index"),
        F.lit(0).cast("bigint").alias("start_sample"),
        F.lit(rate).alias("sample_rate_hz"),
        silent.alias("before"),
        F.array("embedding").alias("samples"),
        silent.alias("after"),
    )


def label_frames(t: Tables) -> DataFrame:
    """Embeddings of one label in id order: the frames of one recording."""
    rows = t.embeddings.select(F.col("label").cast("string").alias("recording_id"), "vec_id", "embedding")
    return with_position(rows, ["recording_id"], "vec_id", F.floor(F.col("vec_id") / 4_096), "frame")


def catalog(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("track_id"),
        F.col("source").alias("artist_id"),
        F.col("lang").alias("genre_top"),
        F.col("n_chars").alias("metadata_duration_seconds"),
        # every seventh track has terms that the catalog doesn't take
        F.when(F.col("doc_id") % 7 == 0, "all rights reserved").otherwise(F.concat(F.lit(" "), F.lit(X.LICENSE))).alias("license"),
    )


def archive_members(t: Tables) -> DataFrame:
    number = F.format_string("%06d", F.col("doc_id"))
    return t.labels.select(
        F.concat(F.lit("fma_full/"), F.substring(number, 1, 3), F.lit("/"), number, F.lit(".mp3")).alias("archive_member")
    )
