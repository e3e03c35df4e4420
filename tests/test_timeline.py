import random

import numpy as np
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.operators.joins import attach, points_in_intervals
from songframe.operators.ordered import with_position, with_previous, with_running_total

KEYS = ["recording_id", "hypothesis_id"]


def test_rounding_is_half_even(spark):
    row = spark.range(1).select(X.half_even(F.lit(2.5)), X.half_even(F.lit(0.5)), X.half_even(F.lit(3.5))).first()
    assert tuple(row) == (2, 0, 4)


def test_frames_before_equals_binary_search(spark):
    rng = random.Random(3)
    for n_fft, hop, rate, frames in ((1024, 256, 44100, 4000), (4096, 1024, 44100, 1000), (512, 512, 8000, 300)):
        centers = np.arange(n_fft / 2, n_fft / 2 + frames * hop, hop) / float(rate)
        times = [rng.uniform(-0.1, centers[-1] + 0.2) for _ in range(1500)] + [float(c) for c in rng.sample(list(centers), 200)]
        times += [float(np.nextafter(c, 9e9)) for c in centers[:100]] + [0.0, float(centers[-1]) + 100]
        df = spark.createDataFrame([(float(t),) for t in times], "t double")
        got = [r[0] for r in df.select(X.frames_before("t", F.lit(n_fft), F.lit(hop), F.lit(rate), F.lit(frames))).collect()]
        assert got == np.searchsorted(centers[:frames], times, side="left").tolist()


def test_ordered_helpers_match_a_loop_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", i, rng.randint(0, 9)) for i in range(3_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    bucket = F.floor(F.col("i") / 37)
    last, total, seen, want = {}, {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = (last.get(k), total.get(k, 0), seen.get(k, 0))
        last[k], total[k], seen[k] = v, total.get(k, 0) + v, seen.get(k, 0) + 1
    lagged = with_previous(df, ["k"], "i", bucket, {"p": "v"})
    summed = with_running_total(lagged, ["k"], "i", bucket, F.col("v"), "s")
    placed = with_position(summed, ["k"], "i", bucket, "n")
    assert {r.i: (r.p, r.s, r.n) for r in placed.collect()} == want


def test_points_in_intervals_is_exact(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), round(rng.uniform(0, 100), 1)) for _ in range(400)]
    intervals = [(rng.choice("ab"), i, *sorted((round(rng.uniform(0, 100), 1), round(rng.uniform(0, 100), 1)))) for i in range(30)]
    p = spark.createDataFrame(points, "k string, t double")
    s = spark.createDataFrame(intervals, "k string, i int, a double, b double")
    for closed in (False, True):
        got = sorted((r.k, r.t, r.i) for r in points_in_intervals(p, s, ["k"], "t", "a", "b", 7.0, closed).collect())
        want = sorted((k, t, i) for k, t in points for q, i, a, b in intervals if k == q and (a <= t if closed else a < t) and t < b)
        assert got == want


def test_attach_keeps_every_row_once(spark):
    detail = spark.range(500).select(F.lit("hot").alias("k"), "id").unionByName(spark.range(500, 510).select(F.lit("none").alias("k"), "id"))
    joined = attach(detail, spark.createDataFrame([("hot", 7)], "k string, v int"), ["k"], "id")
    assert joined.count() == 510 and joined.filter("v = 7").count() == 500


def test_contiguity(spark):
    schema = "recording_id string, hypothesis_id string, section_index bigint, start_seconds double, end_seconds double"
    rows = [
        ("good", "h", 0, 0.0, 1.0), ("good", "h", 1, 1.0 + 5e-7, 2.0),
        ("gap", "h", 0, 0.0, 1.0), ("gap", "h", 1, 1.5, 2.0),
        ("late", "h", 0, 0.5, 2.0), ("short", "h", 0, 0.0, 1.5), ("long", "h", 0, 0.0, 2.5), ("flat", "h", 0, 0.0, 0.0), ("flat", "h", 1, 0.0, 2.0),
    ]
    durations = spark.createDataFrame([(r, "h", 2.0) for r in ("good", "gap", "late", "short", "long", "flat", "none")], "recording_id string, hypothesis_id string, duration_seconds double")
    got = sorted((r.recording_id, r.check) for r in TL.contiguity_violations(spark.createDataFrame(rows, schema), durations, KEYS, "section_index", "structure").collect())
    assert got == [("flat", "non_positive"), ("gap", "discontinuous"), ("late", "discontinuous"), ("long", "incomplete"), ("long", "past_end"), ("none", "missing_intervals"), ("short", "incomplete")]


def test_point_order(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.5), ("a", 2, 3.0), ("b", 0, -0.1), ("b", 1, 0.2)]
    points = spark.createDataFrame(rows, "recording_id string, beat_index bigint, seconds double")
    durations = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "recording_id string, duration_seconds double")
    got = sorted((r.recording_id, r.check, r.subject) for r in TL.order_violations(points, durations, ["recording_id"], "beat_index", "seconds", "beats").collect())
    assert got == [("a", "not_increasing", "1"), ("a", "past_end", "2"), ("b", "before_start", "0")]


def test_alignment_clips_only_the_end(spark):
    intervals = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 2.0000004)], "recording_id string, section_index bigint, start_seconds double, end_seconds double")
    recordings = spark.createDataFrame([("a", 44_100, 88_200)], "recording_id string, sample_rate_hz int, frame_count bigint")
    meta = spark.createDataFrame([("a", "mixture", "test", 1024, 256, 44_100, 341)], "recording_id string, track string, config string, n_fft int, hop_length int, sample_rate_hz int, time_frames bigint")
    rows = TL.align_intervals(intervals, recordings, meta, "section_index").orderBy("section_index").collect()
    assert [(r.start_sample, r.end_sample) for r in rows] == [(0, 44_100), (44_100, 88_200)]
    assert rows[0].spectrogram_frames["test"].start == 0 and rows[1].spectrogram_frames["test"].end == 341
