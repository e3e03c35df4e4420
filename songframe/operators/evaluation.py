"""Boundaries and labels against annotations, and several hypotheses of one recording side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songframe.operators import timeline as TL
from songframe.operators.joins import points_in_intervals

TOLERANCES = (0.5, 3.0)
# Seconds of points that are summed up at once; at least the largest tolerance.
MATCH_RUN = 64.0
# Points in a row of a summary at most; stretches of points are scanned side by side.
STRETCH = 256
# What a stretch does: its points, bounds of the number waiting, pairs if none waits, and what waiting points of either side add at most.
_EFFECT = ("estimated", "reference", "low", "high", "found", "of_estimates", "of_references")
_MANY = 1 << 60
# Seconds per cell in which intervals and the pieces they cover meet.
OVERLAY_CELL = 64.0


def _edges(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin that differ from the row before in any of the columns; the first row always is one."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for column in columns:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def _reach(seconds, side, count, begin, tolerance: float) -> np.ndarray:
    """How many points of the other side lie at most ``tolerance`` before each point of its run.

    Points are in order of run and time, estimates before references of the same time; ``begin`` is
    where each point's run begins. All points are searched for at once.
    """
    low, high, wanted = begin.copy(), np.arange(len(seconds)), seconds - tolerance
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        early = seconds[middle] < wanted[open_]
        low[open_] = np.where(early, middle + 1, low[open_])
        high[open_] = np.where(early, high[open_], middle)
    at = np.arange(len(seconds))
    ahead = [np.concatenate(([0], np.cumsum(np.where(side == i, count, 0)))) for i in (0, 1)]
    return np.where(side == 0, ahead[1][at] - ahead[1][low], ahead[0][at] - ahead[0][low])


def _scans(side, count, reach, begin, stop) -> tuple[np.ndarray, np.ndarray]:
    """Points waiting after each stretch [begin, stop), and pairs found in it, if none, all or all of the other side wait before.

    Positive numbers are waiting estimates, negative ones waiting references; only one kind ever
    waits, and always its latest points. A point drops those out of reach and takes the others.
    ``reach`` has a row per tolerance. All stretches go forward together, a point at a time.
    """
    order = np.argsort(begin - stop, kind="stable")  # the longest first
    begin, length = begin[order], (stop - begin)[order]
    waiting = np.zeros((3, len(reach), len(begin)), dtype=np.int64)
    waiting[1], waiting[2] = _MANY, -_MANY
    found = np.zeros_like(waiting)
    for t in range(int(length.max()) if len(length) else 0):
        some = int(np.searchsorted(-length, -t))
        at = begin[:some] + t
        n, c, sign = count[at], reach[:, at], 1 - 2 * side[at]
        # seen from the point's own side, what waits of the other side is negative
        own = np.maximum(waiting[:, :, :some] * sign, -c)
        found[:, :, :some] += np.minimum(n, np.maximum(0, -own))
        waiting[:, :, :some] = (own + n) * sign
    back = np.argsort(order)
    return waiting[:, :, back], found[:, :, back]


def _summed_up(keys: list[str], tolerances: tuple[float, ...]):
    """Rows (keys, run, seconds, side, own, n), in order, to what each stretch of a run's own points does."""
    group = [*keys, "run"]

    def summary(rows: pa.RecordBatch) -> pa.RecordBatch:
        seconds, side = (rows.column(c).to_numpy() for c in ("seconds", "side"))
        count, own = rows.column("n").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False)
        runs = _edges([rows.column(c) for c in group])
        begin = np.repeat(runs, np.diff(np.append(runs, len(seconds))))
        reach = np.stack([_reach(seconds, side, count, begin, x) for x in tolerances])
        # a run's own points follow those before it, and are cut into stretches
        mine = np.flatnonzero(own)
        place = np.arange(len(mine))
        head = np.flatnonzero(np.diff(begin[mine], prepend=-1))
        part = (place - np.repeat(head, np.diff(np.append(head, len(mine))))) // STRETCH
        cut = np.flatnonzero((np.diff(begin[mine], prepend=-1) != 0) | (np.diff(part, prepend=0) != 0))
        side, count, reach = side[mine], count[mine], reach[:, mine]
        waiting, found = _scans(side, count, reach, cut, np.append(cut[1:], len(mine)))
        totals = [np.add.reduceat(np.where(side == i, count, 0), cut) if len(cut) else np.zeros(0, np.int64) for i in (0, 1)]
        each = len(tolerances)
        columns = [rows.column(c).take(pa.array(np.tile(mine[cut], each))) for c in group]
        columns += [pa.array(np.tile(part[cut], each)), pa.array(np.repeat(np.array(tolerances, dtype=float), len(cut)))]
        columns += [pa.array(np.tile(x, each)) for x in totals]
        columns += [pa.array(x.ravel()) for x in (waiting[2], waiting[1], found[0], found[1] - found[0], found[2] - found[0])]
        return pa.RecordBatch.from_arrays(columns, [*group, "part", "tolerance", *_EFFECT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last run may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_edges([batch.column(c) for c in group])[-1])
            seam = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]) if held else None
            if held and len(_edges([seam.column(c) for c in group])) > 1:
                yield summary(pa.concat_batches(held))
                held = []
            if last:
                yield summary(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield summary(pa.concat_batches(held))

    return run


def _chained(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up the stretches of a key and tolerance: estimated, reference and matched points."""
    effect = F.sort_array(F.collect_list(F.struct("run", "part", *_EFFECT)))
    totals = [F.sum(c).alias(c) for c in ("estimated", "reference")]
    lists = stretches.groupBy(*keys, "tolerance").agg(*totals, effect.alias("effects"))
    zero = F.lit(0).cast("bigint")

    def after(state, x):
        before = state["waiting"]
        taken = F.least(F.greatest(before, zero), x["of_estimates"]) + F.least(F.greatest(-before, zero), x["of_references"])
        moved = F.least(F.greatest(before + x["estimated"] - x["reference"], x["low"]), x["high"])
        return F.struct(moved.alias("waiting"), (state["matched"] + x["found"] + taken).alias("matched"))

    start = F.struct(zero.alias("waiting"), zero.alias("matched"))
    matched = F.aggregate("effects", start, after, lambda state: state["matched"])
    return lists.select(*keys, "tolerance", "estimated", "reference", matched.alias("matched"))


def boundary_counts(
    estimated: DataFrame, reference: DataFrame, keys: list[str],
    tolerances: tuple[float, ...] = TOLERANCES, run_seconds: float = MATCH_RUN,
) -> DataFrame:
    """(keys, tolerance, estimated, reference, matched): points, and the most one-to-one pairs at most ``tolerance`` seconds apart.

    Both tables need the keys and ``seconds``. Taking each point's earliest partner in time order is
    optimal on a line. What such a scan carries along is the number of points that wait for a
    partner. A stretch of time changes that number by a shift between two bounds, and each point that
    waits before it adds one pair up to a bound for its side, since later points reach all that
    earlier ones do. Stretches are therefore summed up apart, once, and chained with one row each: the
    result does not depend on where they are cut. Equal points travel as one row with a count. Null times are
    left out, as are keys without a point.
    """
    if run_seconds < max(tolerances):
        raise ValueError("a run has to span the largest tolerance")
    sides = [
        df.filter(F.col("seconds").isNotNull()).select(*keys, F.col("seconds").cast("double").alias("seconds"), F.lit(i).alias("side"))
        for i, df in enumerate((estimated, reference))
    ]
    points = sides[0].unionByName(sides[1])
    run = F.floor(F.col("seconds") / run_seconds)
    nearly = F.col("seconds") + max(tolerances) * 1.001 >= (run + 1) * run_seconds
    placed = points.select("*", F.inline(F.array_compact(F.array(
        F.struct(run.alias("run"), F.lit(True).alias("own")),
        F.when(nearly, F.struct((run + 1).alias("run"), F.lit(False).alias("own"))),
    ))))
    # one shuffle serves the counts and the runs
    placed = placed.repartition(*keys, "run").groupBy(*keys, "run", "seconds", "side", "own").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.sortWithinPartitions(*keys, "run", "seconds", "side")
    fields = [*[points.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("run", "part")]]
    fields += [T.StructField("tolerance", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in _EFFECT]]
    return _chained(placed.mapInArrow(_summed_up(keys, tolerances), T.StructType(fields)), keys)


def boundary_matches(
    estimated: DataFrame, reference: DataFrame, keys: list[str],
    tolerances: tuple[float, ...] = TOLERANCES, run_seconds: float = MATCH_RUN,
) -> DataFrame:
    """(keys, tolerance, matched) of ``boundary_counts``."""
    return boundary_counts(estimated, reference, keys, tolerances, run_seconds).select(*keys, "tolerance", "matched")


def boundary_quality(
    estimated: DataFrame, reference: DataFrame, keys: list[str],
    tolerances: tuple[float, ...] = TOLERANCES, run_seconds: float = MATCH_RUN,
) -> DataFrame:
    """Precision, recall and F of boundaries per key and tolerance; null where there is nothing to divide by."""
    matched = F.col("matched")
    share = lambda of: F.when(F.col(of) > 0, matched / F.col(of))
    return boundary_counts(estimated, reference, keys, tolerances, run_seconds).select(
        *keys, "tolerance", "estimated", "reference", "matched", share("estimated").alias("precision"), share("reference").alias("recall"),
        (2 * matched / (F.col("estimated") + F.col("reference"))).alias("f_measure"),
    )


def overlay(
    intervals: DataFrame, keys: list[str], hypothesis: str = "hypothesis_id", cell_seconds: float = OVERLAY_CELL
) -> DataFrame:
    """Cut each key's time at every boundary of every hypothesis: one row per piece and hypothesis.

    ``intervals`` needs the keys, the hypothesis, start_seconds, end_seconds and label. A piece lies
    between two neighbouring boundaries and has the label of the interval around it; where a
    hypothesis overlaps itself, of the one that starts last, then of the greater label. Pieces that no
    hypothesis covers, and intervals without length, give no rows.
    """
    real = intervals.filter(F.col("end_seconds") > F.col("start_seconds")).select(
        *keys, hypothesis, "label", F.col("start_seconds").alias("__start"), F.col("end_seconds").alias("__end")
    )
    edges = real.select(*keys, F.col("__start").alias("seconds")).union(real.select(*keys, F.col("__end").alias("seconds"))).distinct()
    pieces = TL.intervals_between(edges, keys, "seconds")
    covered = points_in_intervals(pieces, real, keys, "start_seconds", "__start", "__end", cell_seconds, include_start=True)
    return covered.groupBy(*keys, "start_seconds", "end_seconds", hypothesis).agg(
        F.max(F.struct("__start", "label"))["label"].alias("label")
    )


def agreement(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Per piece of ``overlay``: hypotheses that cover it, the label most of them give, and how many do.

    On a tie the least label counts.
    """
    piece = [*keys, "start_seconds", "end_seconds"]
    votes = pieces.groupBy(*piece, "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "label"))
    return votes.groupBy(*piece).agg(F.sum("n").alias("hypotheses"), best.alias("best")).select(
        *piece, "hypotheses", F.col("best.label").alias("label"), (-F.col("best.n")).alias("agreeing")
    )


def label_confusion(estimated: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds for which an estimated label meets a reference label, per key; null where one side has none."""
    sides = estimated.withColumn("__side", F.lit("estimated")).select(*keys, "__side", "start_seconds", "end_seconds", "label").unionByName(
        reference.withColumn("__side", F.lit("reference")).select(*keys, "__side", "start_seconds", "end_seconds", "label")
    )
    pieces = overlay(sides, keys, "__side")
    of = lambda side: F.max(F.when(F.col("__side") == side, F.col("label"))).alias(f"{side}_label")
    both = pieces.groupBy(*keys, "start_seconds", "end_seconds").agg(of("estimated"), of("reference"))
    return both.groupBy(*keys, "estimated_label", "reference_label").agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("seconds"))
