"""Boundary matching against augmenting paths, overlays against every instant, defects against whole signals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from songframe.operators import defects as DF
from songframe.operators import evaluation as EV


def most_pairs(est, ref, tolerance):
    partner = {}

    def place(i, seen):
        for j, r in enumerate(ref):
            if abs(est[i] - r) <= tolerance and j not in seen:
                seen.add(j)
                if j not in partner or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(est)))


@pytest.mark.parametrize("run_seconds", [3.0, 8.0, 500.0])
def test_matching_is_largest_for_any_run(spark, run_seconds):
    rng = random.Random(1)
    songs = {}
    for s in range(25):
        span = rng.choice((5, 20, 60))
        draw = lambda: [rng.randint(0, span * 4) / 4 for _ in range(rng.randint(0, 40))]  # noqa: B023, E731
        songs[f"s{s}"] = (draw(), draw())
    rows = [[(k, x) for k, v in songs.items() for x in v[i]] + [("s0", None)] for i in (0, 1)]
    est, ref = (spark.createDataFrame(r, "song string, seconds double") for r in rows)
    got = {(r.song, r.tolerance): r for r in EV.boundary_quality(est, ref, ["song"], (0.5, 3.0), run_seconds).collect()}
    for song, (a, b) in songs.items():
        for tolerance in (0.5, 3.0):
            if not a and not b:
                continue
            row, want = got[song, tolerance], most_pairs(a, b, tolerance)
            assert (row.estimated, row.reference, row.matched) == (len(a), len(b), want)
            assert row.precision == (want / len(a) if a else None) and row.recall == (want / len(b) if b else None)
            assert row.f_measure == 2 * want / (len(a) + len(b))


def test_a_run_has_to_span_the_tolerance(spark):
    df = spark.createDataFrame([("a", 1.0)], "song string, seconds double")
    with pytest.raises(ValueError):
        EV.boundary_quality(df, df, ["song"], (3.0,), 1.0)
    assert EV.boundary_quality(df.limit(0), df.limit(0), ["song"]).count() == 0


def scan(est, ref, tolerance):
    """Earliest partners in time order, as the SQL walks."""
    est, ref, i, j, found = sorted(est), sorted(ref), 0, 0, 0
    while i < len(est) and j < len(ref):
        if abs(est[i] - ref[j]) <= tolerance:
            i, j, found = i + 1, j + 1, found + 1
        elif est[i] < ref[j]:
            i += 1
        else:
            j += 1
    return found


@pytest.mark.parametrize("batch", [7, 10_000])
def test_runs_are_summed_up_once_and_cut_anywhere(spark, batch):
    """Runs of many stretches that go on over batches; Spark forms no Python group per run or key."""
    rng = random.Random(5)
    songs = {}
    for s, (a, b, span) in enumerate([(900, 900, 100), (1500, 300, 64), (40, 2000, 400), (700, 0, 70), (0, 300, 30), (600, 600, 5000)]):
        songs[f"s{s}"] = [[rng.randint(0, span * 1000) / 1000 for _ in range(n)] for n in (a, b)]
    # waiting points of one side pass through many stretches before the other side takes them
    songs["late"] = [[3.0 + i / 1000 for i in range(800)] * 2, [5.9 + i / 500 for i in range(1000)]]
    songs[None] = [[1.0], []]
    est, ref = (spark.createDataFrame([(k, x) for k, v in songs.items() for x in v[i]], "song string, seconds double") for i in (0, 1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out = EV.boundary_quality(est, ref, ["song"])
        got = {(r.song, r.tolerance): (r.estimated, r.reference, r.matched) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(k, x): (len(a), len(b), scan(a, b, x)) for k, (a, b) in songs.items() for x in EV.TOLERANCES}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


def test_overlay_and_agreement(spark):
    rng = random.Random(4)
    rows = []
    for song in ("a", "b"):
        for h in ("x", "y", "z"):
            at = 0
            while at < 300:
                end = at + rng.randint(1, 90)
                if rng.random() < 0.8:
                    rows.append((song, h, float(at), float(end), rng.choice("uvw")))
                at = end
    rows.append(("a", "x", 5.0, 5.0, "empty"))
    df = spark.createDataFrame(rows, "song string, hypothesis_id string, start_seconds double, end_seconds double, label string")
    pieces = EV.overlay(df, ["song"])
    got = {}
    for r in pieces.collect():
        for at in range(int(r.start_seconds), int(r.end_seconds)):
            got[r.song, r.hypothesis_id, at] = r.label
    want = {(s, h, at): label for s, h, a, b, label in rows for at in range(int(a), int(b))}
    assert got == want
    for r in EV.agreement(pieces, ["song"]).collect():
        labels = [want[r.song, h, int(r.start_seconds)] for h in "xyz" if (r.song, h, int(r.start_seconds)) in want]
        best = min(labels, key=lambda x: (-labels.count(x), x))
        assert (r.hypotheses, r.label, r.agreeing) == (len(labels), best, labels.count(best))


def test_confusion_adds_up(spark):
    schema = "song string, start_seconds double, end_seconds double, label string"
    est = spark.createDataFrame([("a", 0.0, 10.0, "verse"), ("a", 10.0, 30.0, "chorus")], schema)
    ref = spark.createDataFrame([("a", 0.0, 15.0, "verse"), ("a", 15.0, 25.0, "chorus")], schema)
    got = {(r.estimated_label, r.reference_label): r.seconds for r in EV.label_confusion(est, ref, ["song"]).collect()}
    assert got == {("verse", "verse"): 10.0, ("chorus", "verse"): 5.0, ("chorus", "chorus"): 10.0, ("chorus", None): 5.0}


def longest(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


@pytest.mark.parametrize("run_blocks", [1, 3, 1_024])
def test_runs_over_block_edges(spark, monkeypatch, run_blocks):
    monkeypatch.setattr(DF, "RUN_BLOCKS", run_blocks)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for song in range(30):
        size, n = int(rng.integers(1, 7)), int(rng.integers(1, 60))
        signal = rng.choice([0.0, 0.3, 1.0], n, p=[0.6, 0.2, 0.2] if song % 2 else [0.2, 0.2, 0.6])
        skip = int(rng.integers(0, 8)) if song % 3 == 0 else -1
        kept, pieces = [], []
        for b, at in enumerate(range(0, n, size)):
            if b == skip:
                pieces.append(None)
                continue
            part = [float(x) for x in signal[at : at + size]]
            rows.append((f"r{song}", "mixture", b, at, 10, [part, [0.0] * len(part)]))
            kept += part
            pieces.append(part)
        runs, here = [], []
        for p in pieces:
            if p is None:
                runs.append(here)
                here = []
            else:
                here = here + p
        runs.append(here)
        if kept:
            most = lambda f: max(longest([f(x) for x in r]) for r in runs)  # noqa: B023, E731
            want[f"r{song}"] = (len(kept), sum(x == 0 for x in kept), most(lambda x: x == 0), sum(x == 1 for x in kept), most(lambda x: x == 1))
    blocks = spark.createDataFrame(rows, "recording_id string, track string, block_index bigint, start_sample bigint, sample_rate_hz int, samples array<array<float>>")
    got = {r.recording_id: (r.samples, r.silent_samples, r.silent_run, r.clipped_samples, r.clipped_run) for r in DF.recording_defects(blocks).collect()}
    assert got == want


def test_defect_rows(spark):
    flat, loud = [[0.0] * 4], [[0.5, 1.0, 1.0, 1.0]]
    rows = [("still", 0, 0, flat), ("still", 1, 4, flat), ("hot", 0, 0, loud), ("hot", 1, 4, [[1.0] * 3]), ("torn", 0, 0, [[0.2] * 4]), ("torn", 2, 8, [[0.2] * 2]), ("fine", 0, 0, [[0.1] * 4])]
    blocks = spark.createDataFrame([(r, "mixture", b, s, 2, x) for r, b, s, x in rows], "recording_id string, track string, block_index bigint, start_sample bigint, sample_rate_hz int, samples array<array<float>>")
    recordings = spark.createDataFrame([("still", 8), ("hot", 7), ("torn", 12), ("fine", 4), ("gone", 3)], "recording_id string, frame_count bigint")
    found = DF.defect_violations(DF.recording_defects(blocks), recordings, silent_seconds=3.0, clipped_samples=5)
    assert {(r.recording_id, r.check, r.detail) for r in found.collect()} == {
        ("still", "silent", "8"), ("hot", "clipped", "6"), ("torn", "missing_blocks", "1"), ("torn", "truncated", "10"), ("gone", "truncated", "0"),
    }
    assert DF.recording_defects(blocks.filter(F.lit(False))).count() == 0
