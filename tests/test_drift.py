"""Alarms and missing stretches against plain loops."""

import random

import numpy as np
import pytest

from songframe.operators import drift as DR


def alarms(values, slack, alarm):
    mean = sum(values) // len(values)
    found = []
    for name, sign in (("up", 1), ("down", -1)):
        s = 0
        for i, v in enumerate(values):
            was, s = s, max(0, s + sign * (v - mean) - slack)
            if s >= alarm > was:
                found.append((i, name, s))
    return found


@pytest.mark.parametrize("run", [1, 4, 1_024])
def test_alarms_for_any_bucket(spark, monkeypatch, run):
    monkeypatch.setattr(DR, "RUN_BLOCKS", run)
    rng = random.Random(7)
    tracks = {}
    for i in range(25):
        level = rng.randint(-3_000, -1_000)
        tracks[f"r{i}"] = [level + rng.randint(-200, 200) + (900 if i % 3 == 0 and 10 < j < 30 else 0) for j in range(rng.randint(1, 60))]
    df = spark.createDataFrame([(k, "bass", j, v) for k, x in tracks.items() for j, v in enumerate(x)], "recording_id string, track string, block_index bigint, level bigint")
    got = sorted((r.recording_id, r.block_index, r.direction, r.excess) for r in DR.change_alarms(df, ["recording_id", "track"], "block_index", "level", 100, 1_500).collect())
    want = sorted((k, *a) for k, x in tracks.items() for a in alarms(x, 100, 1_500))
    assert got == want and want


@pytest.mark.parametrize("run", [2, 1_024])
def test_missing_stretches(spark, monkeypatch, run):
    monkeypatch.setattr(DR, "RUN_BLOCKS", run)
    rng = random.Random(3)
    rows, want = [], []
    for i in range(20):
        gone = [rng.random() < 0.6 for _ in range(30)]
        for j, g in enumerate(gone):
            rows.append((f"r{i}", "mixture", j, -1_000))
            if not g or rng.random() < 0.5:
                rows.append((f"r{i}", "vocals", j, -9_000 if g else -1_200))
        j = 0
        while j < 30:
            k = j
            while k < 30 and gone[k]:
                k += 1
            if k - j >= 4:
                want.append((f"r{i}", k - 1, k - j))
            j = max(k, j + 1)
    df = spark.createDataFrame(rows, "recording_id string, track string, block_index bigint, level bigint")
    assert sorted((r.recording_id, r.last_block, r.blocks) for r in DR.missing_runs(df).collect()) == sorted(want)


def test_levels_and_violations(spark):
    loud, quiet = [[0.5] * 8], [[0.0] * 8]
    rows = [("a", t, b, s) for b in range(6) for t, s in (("mixture", loud), ("vocals", quiet if b > 1 else loud), ("bass", loud))]
    blocks = spark.createDataFrame([*rows, ("b", "bass", 0, None), ("b", "bass", 1, [[]])], "recording_id string, track string, block_index bigint, samples array<array<float>>")
    levels = DR.block_levels(blocks)
    found = {(r.recording_id, r.track, r.block_index): r.level for r in levels.collect()}
    assert found["a", "bass", 0] == round(2_000 * np.log10(0.5)) and found["a", "vocals", 4] == found["b", "bass", 0] == found["b", "bass", 1] == DR.SILENT_LEVEL
    rows = {(r.recording_id, r.check, r.subject) for r in DR.drift_violations(levels).collect()}
    assert ("a", "missing_vocals", "5") in rows and ("a", "level_up", "vocals/0") in rows
    assert all(r[0] == "a" for r in rows)
