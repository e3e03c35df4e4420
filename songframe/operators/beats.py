"""The best beat sequence of a recording of any length, as a scan over blocks of frames.

The score of a frame is its own strength plus the best of the frames one gap earlier, a gap costing
the more the further it is from the period. All a block needs to know of the past are the scores of
as many frames as the longest gap; what it does to them is linear in (max, +), so blocks compute
that as a matrix side by side, the matrices are applied in turn, and then all blocks are solved at
once. Going back, a block is a table from the frame at which a sequence enters it to where it leaves.
Scores are whole numbers, so sums are the same however blocks are cut, and ties go to the shorter gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.session import cut_lineage

TIGHTNESS = 100.0
# Frames in a block, about three minutes at 512-sample hops, and units of a score.
BLOCK_FRAMES = 16_384
UNITS = 1 << 16
# Frames of blocks solved side by side.
CELLS = 1 << 19
# Onsets are counted in whole units for their deviation, so that it doesn't depend on any order.
ONSET_UNITS = 1 << 20
_NEVER = -(1 << 60)


def gap_costs(period: int) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.arange(max(1, period // 2), 2 * period + 1)
    return gaps, np.rint(-TIGHTNESS * np.log(gaps / period) ** 2 * UNITS).astype(np.int64)


def local_scores(onset: np.ndarray, deviation: float, period: int) -> np.ndarray:
    """Onset strength around each frame in whole units; ``onset`` has a period of context on both sides."""
    reach = np.arange(-period, period + 1)
    weights = np.exp(-0.5 * (reach * 32.0 / period) ** 2)
    return np.rint(np.convolve(onset / deviation, weights, mode="valid") * UNITS).astype(np.int64)


def solve_many(local: np.ndarray, past: np.ndarray, period: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the frames of blocks of one length and period, a row each, and the gap back from each frame (0 where none fits).

    ``past`` are the scores of the 2 * period frames before, the last one at the end. In a recording's
    first block frames with no earlier one at a fitting gap start a sequence.
    """
    gaps, cost = gap_costs(period)
    size, shortest = 2 * period, int(gaps[0])
    # frames come first, so that what one step reads and writes lies together
    total = np.ascontiguousarray(np.concatenate((past, local), axis=1).T)
    back = np.zeros((local.shape[1], local.shape[0]), dtype=np.int64)
    for t in range(local.shape[1]):
        usable = min(len(gaps), max(0, t - shortest + 1)) if first else len(gaps)
        if usable:
            stop = size + t - shortest + 1
            options = total[stop - usable : stop][::-1] + cost[:usable, None]
            best = options.argmax(0)
            total[size + t] += options.max(0)
            back[t] = gaps[best]
    return total[size:].T, back.T


def solve(local: np.ndarray, past: np.ndarray, period: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """``solve_many`` for one block."""
    total, back = solve_many(local[None, :], past[None, :], period, first)
    return total[0], back[0]


def transfer(local: np.ndarray, period: int) -> np.ndarray:
    """Row i, column j: what the score i before the block's end gains from the score j before its start."""
    gaps, cost = gap_costs(period)
    size = 2 * period
    rows = np.full((size + len(local), size), _NEVER, dtype=np.int64)
    rows[np.arange(size), size - 1 - np.arange(size)] = 0
    for t in range(len(local)):
        rows[size + t] = np.maximum(local[t] + (rows[size + t - gaps] + cost[:, None]).max(0), _NEVER)
    return rows[: -size - 1 : -1]


def follow_beats(onset: np.ndarray, period: int) -> np.ndarray:
    """Frames of the best beat sequence of one short recording."""
    deviation = onset.std(ddof=1) if onset.size > 1 else 0.0
    if deviation <= 0:
        return np.zeros(0, dtype=np.int64)
    local = local_scores(np.pad(onset, period), deviation, period)
    total, back = solve(local, np.full(2 * period, _NEVER), period, True)
    back[: first_strong(local, int(local.max()))] = 0
    beat = max(0, len(local) - 2 * period) + int(total[max(0, len(local) - 2 * period) :].argmax())
    beats = [beat]
    while back[beats[-1]]:
        beats.append(beats[-1] - back[beats[-1]])
    return np.array(beats[::-1], dtype=np.int64)


def first_strong(local: np.ndarray, largest: int) -> int:
    """The first frame with a hundredth of the largest score; sequences begin before or there."""
    strong = np.flatnonzero(100 * local >= largest)
    return int(strong[0]) if len(strong) else len(local)


def _array(cell) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def scored_blocks(frames: DataFrame, periods: DataFrame, block_frames: int) -> DataFrame:
    """recording_id, period, block, first (the recording's first frame), last_block, local: one row per block."""
    stats = frames.groupBy("recording_id").agg(
        F.min("frame_index").alias("first"), F.max("frame_index").alias("final"), F.count(F.lit(1)).alias("n"),
        F.sum(F.rint(F.col("onset") * ONSET_UNITS).cast("decimal(38,0)")).alias("s"),
        F.sum((F.rint(F.col("onset") * ONSET_UNITS).cast("decimal(18,0)") * F.rint(F.col("onset") * ONSET_UNITS).cast("decimal(18,0)")).cast("decimal(38,0)")).alias("ss"),
    ).join(periods, "recording_id")
    spread = (F.col("ss").cast("double") - F.col("s").cast("double") * F.col("s").cast("double") / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))
    stats = stats.withColumn("deviation", F.sqrt(F.greatest(spread, F.lit(0.0))) / ONSET_UNITS).filter("deviation > 0")
    placed = frames.join(stats.select("recording_id", "first", "final", "deviation", F.col("period_frames").alias("period")), "recording_id")
    at = F.col("frame_index") - F.col("first")
    block = lambda shift: F.floor((at + shift) / block_frames)
    own = F.array_distinct(F.array(block(-F.col("period")), block(F.lit(0)), block(F.col("period"))))
    last = F.floor((F.col("final") - F.col("first")) / block_frames)
    listed = placed.select("recording_id", "first", "final", "deviation", "period", at.alias("at"), "onset", last.alias("last_block"), F.explode(own).alias("block"))
    listed = listed.filter((F.col("block") >= 0) & (F.col("block") <= F.col("last_block")))

    head = ["recording_id", "first", "final", "deviation", "period", "last_block", "block"]
    packed = listed.groupBy(*head).agg(F.array_sort(F.collect_list(F.struct("at", "onset"))).alias("heard"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            locals_ = []
            for row in _cells(batch):
                begin, period = row["block"].as_py() * block_frames, row["period"].as_py()
                stop = min(begin + block_frames, row["final"].as_py() - row["first"].as_py() + 1)
                onset = np.zeros(stop - begin + 2 * period)  # zeros before the start and after the end
                heard = row["heard"].values
                onset[heard.field("at").to_numpy() - begin + period] = heard.field("onset").to_numpy()
                locals_.append(local_scores(onset, row["deviation"].as_py(), period))
            kept = [batch.column(c) for c in ("recording_id", "first", "period", "last_block", "block")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(locals_, pa.list_(pa.int64())), pa.array([int(x.max()) for x in locals_], pa.int64())],
                ["recording_id", "first", "period", "last_block", "block", "local", "largest"],
            )

    schema = "recording_id string, first bigint, period bigint, last_block bigint, block bigint, local array<bigint>, largest bigint"
    return packed.mapInArrow(score, schema)


def best_beats(frames: DataFrame, periods: DataFrame, block_frames: int | None = None) -> DataFrame:
    """recording_id, frame_index, period_frames of the best beat sequence of every recording.

    ``frames``: recording_id, frame_index without holes, onset; ``periods``: recording_id and
    period_frames. The result is that of one pass over the whole recording, whatever the block length, which
    has to be at least two periods. Recordings without a period or with a constant onset have no beats.
    Per recording only one matrix of (2 * period)**2 numbers per block meets in a task.
    """
    block_frames = block_frames or BLOCK_FRAMES
    known = periods.filter(F.col("period_frames").isNotNull()).select("recording_id", F.col("period_frames").cast("bigint"))
    blocks = cut_lineage(scored_blocks(frames.select("recording_id", "frame_index", F.col("onset").cast("double").alias("onset")), known, block_frames))
    largest = blocks.groupBy("recording_id").agg(F.max("largest").alias("largest"))
    blocks = blocks.drop("largest").join(largest, "recording_id")

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _cells(batch):
                local, period = _array(row["local"]), row["period"].as_py()
                whole = row["block"].as_py() > 0
                # the first block knows its scores, all others what they do to any
                matrix = transfer(local, period) if whole else _recent(np.full(2 * period, _NEVER), solve(local, np.full(2 * period, _NEVER), period, True)[0], 2 * period)[::-1]
                yield pa.RecordBatch.from_pydict({
                    "recording_id": [row["recording_id"].as_py()], "period": [period], "block": [row["block"].as_py()],
                    "matrix": pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary()),
                })

    matrices = blocks.filter("block < last_block").select("recording_id", "period", "block", "local").mapInArrow(
        gains, "recording_id string, period bigint, block bigint, matrix binary"
    )

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        size, state, states = 2 * rows.column("period")[0].as_py(), None, []
        for block, matrix in zip(rows.column("block").to_pylist(), rows.column("matrix").to_pylist(), strict=True):
            values = np.frombuffer(matrix, np.int64)
            state = values if block == 0 else np.maximum((values.reshape(size, size) + state[None, :]).max(1), _NEVER)
            states.append(np.ascontiguousarray(state[::-1]))
        return pa.table({
            "recording_id": pa.repeat(key[0], len(states)), "block": pa.array([b + 1 for b in rows.column("block").to_pylist()], pa.int64()),
            "past": pa.array(states, pa.list_(pa.int64())),
        })

    states = matrices.groupBy("recording_id").applyInArrow(chain, "recording_id string, block bigint, past array<bigint>")
    ready = blocks.join(states, ["recording_id", "block"], "left")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _alike(batch):
                period, first = rows[0]["period"].as_py(), rows[0]["block"].as_py() == 0
                size = 2 * period
                local = np.stack([_array(row["local"]) for row in rows])
                past = np.full((len(rows), size), _NEVER) if first else np.stack([_array(row["past"]) for row in rows])
                total, back = solve_many(local, past, period, first)
                strong = 100 * local >= np.array([row["largest"].as_py() for row in rows])[:, None]
                loud = strong.argmax(1)
                back_of = np.where(back > 0, np.arange(back.shape[1]) - back, -size - 1)  # relative to the block, below -size: none
                strongs, finals = [], []
                for i, row in enumerate(rows):
                    begin, final = row["block"].as_py() * block_frames, -1
                    if row["block"] == row["last_block"]:
                        recent = _recent(past[i], total[i], min(size, begin + local.shape[1]))
                        final = begin + local.shape[1] - len(recent) + int(recent.argmax())
                    strongs.append(int(loud[i]) + begin if strong[i, loud[i]] else None)
                    finals.append(final)
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([row[c].as_py() for row in rows]) for c in ("recording_id", "first", "period", "block")},
                    "back": pa.array(list(back_of), pa.list_(pa.int64())), "strong": pa.array(strongs, pa.int64()), "final": pa.array(finals, pa.int64()),
                })

    schema = "recording_id string, first bigint, period bigint, block bigint, back array<bigint>, strong bigint, final bigint"
    done = cut_lineage(ready.select("recording_id", "first", "period", "block", "last_block", "local", "past", "largest").mapInArrow(solved, schema))
    strong = done.groupBy("recording_id").agg(F.min("strong").alias("begins"), F.max("final").alias("ends"), F.max("block").alias("last"))
    done = done.drop("strong", "final").join(strong, "recording_id")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _cells(batch):
                back, size = _stopped(row, block_frames), 2 * row["period"].as_py()
                leaves = back.tolist()
                for t, to in enumerate(leaves):  # a frame's way out is that of the frame it points to
                    if to >= 0:
                        leaves[t] = leaves[to]
                kept = max(0, len(back) - size)
                yield pa.RecordBatch.from_pydict({
                    "recording_id": [row["recording_id"].as_py()], "block": [row["block"].as_py()], "ends": [row["ends"].as_py()], "kept": [kept],
                    "size": [size], "leaves": pa.array([leaves[kept:]], pa.list_(pa.int64())),
                })

    # a recording of one block is entered where its sequence ends
    alone = done.filter("last = 0").select("recording_id", "block", F.col("ends").alias("enters"))
    tables = done.filter("last > 0").drop("last").mapInArrow(exits, "recording_id string, block bigint, ends bigint, kept bigint, size bigint, leaves array<bigint>")

    def chain_back(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "descending")])
        at, found = rows.column("ends")[0].as_py(), []
        for block, kept, size, leaves in zip(*(rows.column(c).to_pylist() for c in ("block", "kept", "size", "leaves")), strict=True):
            begin = block * block_frames
            if at is None or at < begin:
                continue
            found.append((block, at))
            left = leaves[at - begin - kept]
            at = begin + left if left >= -size else None
        return pa.table({
            "recording_id": pa.repeat(key[0], len(found)), "block": pa.array([b for b, _ in found], pa.int64()), "enters": pa.array([a for _, a in found], pa.int64()),
        })

    entries = tables.groupBy("recording_id").applyInArrow(chain_back, "recording_id string, block bigint, enters bigint")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _cells(batch):
                back, begin = _stopped(row, block_frames), row["block"].as_py() * block_frames
                at, beats = row["enters"].as_py() - begin, []
                while at >= 0:
                    beats.append(at + begin + row["first"].as_py())
                    at = int(back[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["recording_id"].as_py()] * len(beats), pa.string()), pa.array(beats, pa.int64()), pa.array([row["period"].as_py()] * len(beats), pa.int64())],
                    ["recording_id", "frame_index", "period_frames"],
                )

    return done.drop("last").join(entries.unionByName(alone), ["recording_id", "block"]).mapInArrow(listed, "recording_id string, frame_index bigint, period_frames bigint")


def _cells(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names}


def _alike(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """Rows of one period and length, first blocks apart, in lists of about ``CELLS`` frames at most."""
    groups: dict[tuple, list[dict]] = {}
    for row in _cells(batch):
        frames = len(row["local"])
        key = row["period"].as_py(), row["block"].as_py() == 0, frames
        rows = groups.setdefault(key, [])
        rows.append(row)
        if len(rows) * frames >= CELLS:
            yield groups.pop(key)
    yield from groups.values()


def _recent(past: np.ndarray, total: np.ndarray, count: int) -> np.ndarray:
    return np.concatenate((past, total))[-count:]


def _stopped(row: dict, block_frames: int) -> np.ndarray:
    """Where each frame of a block points to, cut where the recording has not begun to be loud."""
    back = _array(row["back"]).copy()
    quiet = row["begins"].as_py() - row["block"].as_py() * block_frames if row["begins"].as_py() is not None else len(back)
    back[: max(0, quiet)] = -2 * row["period"].as_py() - 1
    return back
