"""Any interval of a song across its waveforms, frames, beats and sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.operators import timeline as TL
from songframe.operators.joins import overlapping, points_in_intervals
from songframe.sources.ordered_store import OrderedTable

# Up to so many requests their recordings also become a filter that the file reader sees.
LISTED = 1_000
CELL_SECONDS = 64.0


@dataclass(frozen=True)
class Retrieved:
    """What lies in the requested intervals, each table keyed by interval_id.

    samples: track, start_sample and samples, one row per block that the interval meets
    frames: start_sample, end_sample and the frame range on every spectrogram axis
    beats, sections: rows of the structure tables; a section with the part of it that is inside
    """

    samples: DataFrame | None
    frames: DataFrame | None
    beats: DataFrame | None
    sections: DataFrame | None


def stored_length() -> Column:
    """Samples of a block row, for ``save_ordered``."""
    return F.size(F.coalesce(F.get("samples", F.lit(0)), F.array().cast("array<float>")))


def listed_filter(requests: DataFrame, extent: int) -> Column | None:
    """A condition on recording and position that Parquet's own statistics can prune with.

    None where more than ``LISTED`` recordings are asked for; the join decides then.
    """
    wanted = requests.groupBy("recording_id").agg(F.min("start_sample").alias("a"), F.max("end_sample").alias("b")).limit(LISTED + 1).collect()
    if not wanted or len(wanted) > LISTED:
        return None
    inside = F.col("recording_id").isin([r.recording_id for r in wanted])
    return inside & (F.col("start_sample") > min(r.a for r in wanted) - extent) & (F.col("start_sample") < max(r.b for r in wanted))


def samples_in(blocks: OrderedTable, requests: DataFrame) -> DataFrame:
    """interval_id, recording_id, track, start_sample, samples: the parts of blocks inside each interval.

    ``requests`` needs interval_id, recording_id, start_sample and end_sample; ends are exclusive.
    Only files and row groups that hold a requested range are read. Blocks meet requests in an
    equi-join on (recording, cell), a cell being as long as the longest block, so an interval of any
    length is listed once per cell and not put together in one row. What no block holds is left out.
    """
    extent = max(1, blocks.extent())
    asked = requests.select("interval_id", "recording_id", F.col("start_sample").cast("bigint").alias("__from"), F.col("end_sample").cast("bigint").alias("__to"))
    asked = asked.filter("__to > __from")
    rows = blocks.read(asked, "__from", "__to")
    pruned = listed_filter(asked.select("recording_id", F.col("__from").alias("start_sample"), F.col("__to").alias("end_sample")), extent)
    if pruned is not None:
        rows = rows.filter(pruned)
    cell = lambda c: F.floor(c / extent)
    listed = asked.withColumn("__cell", F.explode(F.sequence(cell(F.col("__from") - extent + 1), cell(F.col("__to") - 1))))
    met = rows.withColumn("__cell", cell(F.col("start_sample"))).join(listed, ["recording_id", "__cell"])
    edges = {"__begin": F.greatest("__from", "start_sample"), "__stop": F.least(F.col("__to"), F.col("start_sample") + stored_length())}
    met = met.withColumns(edges).filter("__stop > __begin")
    first, count = (F.col("__begin") - F.col("start_sample") + 1).cast("int"), (F.col("__stop") - F.col("__begin")).cast("int")
    met = met.withColumns({"__first": first, "__count": count})
    cut = F.transform("samples", lambda c: F.slice(c, F.col("__first"), F.col("__count")))
    return met.select("interval_id", "recording_id", "track", F.col("__begin").alias("start_sample"), cut.alias("samples"))


def retrieve(
    requests: DataFrame, recordings: DataFrame, blocks: OrderedTable | None = None, meta: DataFrame | None = None,
    beats: DataFrame | None = None, sections: DataFrame | None = None,
) -> Retrieved:
    """Everything that the library holds about the requested intervals; tables left out give none.

    ``requests``: interval_id, recording_id, start_seconds, end_seconds (exclusive). ``recordings``:
    recording_id, sample_rate_hz, frame_count. Samples follow the same rounding as sections. An
    interval of an unknown recording has frames without positions and nothing else.
    """
    placed = TL.align_intervals(requests.select("interval_id", "recording_id", "start_seconds", "end_seconds"), recordings, meta, "interval_id")
    samples = None if blocks is None else samples_in(blocks, placed)
    named = requests.select("interval_id", "recording_id", F.col("start_seconds").alias("__start"), F.col("end_seconds").alias("__end"))
    inside = None
    if beats is not None:
        inside = points_in_intervals(beats, named, ["recording_id"], "seconds", "__start", "__end", CELL_SECONDS, include_start=True).drop("__start", "__end")
    met = None
    if sections is not None:
        met = overlapping(sections, named, ["recording_id"], "start_seconds", "end_seconds", "__start", "__end", CELL_SECONDS)
        met = met.withColumn("inside_start", F.greatest("start_seconds", "__start")).withColumn("inside_end", F.least("end_seconds", "__end")).drop("__start", "__end")
    return Retrieved(samples, placed, inside, met)
