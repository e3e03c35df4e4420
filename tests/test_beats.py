"""Beat sequences over blocks against one pass over the whole recording."""

import numpy as np
import pytest

from songframe.operators import beats as BT


def one_pass(onset, period):
    """Frames of the best sequence, by a plain loop over all frames and gaps in whole units."""
    n = len(onset)
    deviation = np.std(onset, ddof=1) if n > 1 else 0
    if not deviation:
        return []
    local = BT.local_scores(np.pad(onset, period), deviation, period)
    gaps, cost = BT.gap_costs(period)
    total, back = [], []
    loud = False
    for t in range(n):
        options = [(total[t - g] + c, -g) for g, c in zip(gaps.tolist(), cost.tolist(), strict=True) if g <= t]
        best = max(options) if options else None
        total.append(int(local[t]) + (best[0] if best else 0))
        loud = loud or 100 * local[t] >= local.max()
        back.append(t + best[1] if best and loud else -1)
    begin = max(0, n - 2 * period)
    at = begin + int(np.argmax(total[begin:]))
    found = []
    while at >= 0:
        found.append(at)
        at = back[at]
    return found[::-1]


def recordings(seed):
    rng = np.random.default_rng(seed)
    made = {}
    for i in range(14):
        period, n = int(rng.integers(2, 12)), int(rng.integers(1, 400))
        onset = rng.random(n) * 0.3
        onset[int(rng.integers(0, period)) :: period] += 1
        if i % 3 == 0:
            onset = np.rint(onset)  # many ties
        if i % 4 == 1:
            onset[: n // 3] = 0
        made[f"r{i}"] = (period, np.round(onset, 6), int(rng.integers(0, 500)))
    made["flat"] = (5, np.ones(50), 0)
    made["none"] = (None, rng.random(20), 0)
    return made


@pytest.mark.parametrize("block_frames", [24, 25, 67, 16_384])
def test_any_block_length(spark, block_frames):
    made = recordings(2)
    rows = [(k, first + i, float(x)) for k, (_, onset, first) in made.items() for i, x in enumerate(onset)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_index bigint, onset double").repartition(5)
    periods = spark.createDataFrame([(k, p) for k, (p, _, _) in made.items()], "recording_id string, period_frames bigint")
    got = sorted((r.recording_id, r.frame_index) for r in BT.best_beats(frames, periods, block_frames).collect())
    want = sorted((k, first + b) for k, (p, onset, first) in made.items() if p for b in one_pass(onset, p))
    assert got == want


def test_short_recordings_in_one_pass():
    for period, onset, _ in recordings(5).values():
        if period:
            assert BT.follow_beats(onset, period).tolist() == one_pass(onset, period)


def test_transfer_is_what_solving_does():
    rng = np.random.default_rng(1)
    for period in (1, 2, 7):
        local, past = rng.integers(0, 10**6, 40), rng.integers(-(10**6), 10**7, 2 * period)
        total, _ = BT.solve(local, past, period, False)
        end = (BT.transfer(local, period) + past[::-1][None, :]).max(1)
        assert end.tolist() == total[::-1][: 2 * period].tolist()


def test_blocks_side_by_side_are_solved_as_alone():
    rng = np.random.default_rng(12)
    for period, first in ((1, True), (5, True), (9, False)):
        local = rng.integers(-50, 50, (4, 60)) * 1000
        past = np.full((4, 2 * period), BT._NEVER) if first else rng.integers(-50, 50, (4, 2 * period)) * 1000
        gaps, cost = BT.gap_costs(period)
        totals, backs = BT.solve_many(local, past, period, first)
        for row in range(4):
            total = list(past[row])
            for t in range(60):
                options = [(total[2 * period + t - g] + c, -g) for g, c in zip(gaps, cost, strict=True) if not first or g <= t]
                best = max(options, default=(0, 0))
                total.append(local[row, t] + best[0])
                assert backs[row, t] == -best[1]
            assert totals[row].tolist() == total[2 * period :]
