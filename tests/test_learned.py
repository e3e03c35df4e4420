import math
import random

from pyspark.sql import functions as F

from songframe import schemas
from songframe.functions import exprs as X
from songframe.operators import learned as LN

RECORDINGS = "recording_id string, duration_seconds double, sample_rate_hz int, frame_count bigint"


def fold(spark, segments, duration=10.0):
    df = spark.createDataFrame([("a", "m", i, *s) for i, s in enumerate(segments)], schemas.SEGMENTS)
    recordings = spark.createDataFrame([("a", duration, 100, int(duration * 100))], RECORDINGS)
    return LN.fold_markers(df, recordings)


def test_markers_fold_into_neighbours(spark):
    rows = fold(spark, [(0.0, 0.05, "start"), (0.05, 9.5, "inst"), (9.5, 10.0, "end")]).collect()
    assert [(r.section_index, r.start, r.end, r.label) for r in rows] == [(0, 0.0, 10.0, "instrumental")]


def test_marker_corner_cases(spark):
    shape = lambda s: [(r.start, r.end, r.label) for r in fold(spark, s).orderBy("section_index").collect()]
    assert shape([(0.0, 10.0, "start")]) == [(0.0, 10.0, "start")]
    assert shape([(0.0, 1.0, "start"), (1.0, 9.0, "end")]) == [(0.0, 9.0, "end")]
    assert shape([(0.0, 4.0, "verse"), (4.0, 9.0, "end")]) == [(0.0, 10.0, "verse")]
    assert shape([(0.0, 4.0, "verse"), (4.0, 9.0, "solo")]) == [(0.0, 4.0, "verse"), (4.0, 9.0, "solo")]


def test_sections_against_a_loop(spark):
    rng = random.Random(9)
    frames = 1_000
    logits = [[rng.gauss(0, 2) for _ in range(10)] for _ in range(frames)]
    border = [rng.gauss(0, 1) for _ in range(frames)]
    activations = spark.createDataFrame(
        [("a", "m", i, 0.0, 0.0, border[i], logits[i]) for i in range(frames)], schemas.ACTIVATIONS
    )
    segments = [(-0.2, 0.1, "start"), (0.1, 3.335, "verse"), (3.335, 3.336, "mystery"), (3.336, 9.7, "chorus"), (9.7, 9.9, "end")]
    df = spark.createDataFrame([("a", "m", i, *s) for i, s in enumerate(segments)], schemas.SEGMENTS)
    recordings = spark.createDataFrame([("a", 10.0, 44_100, 441_000)], RECORDINGS)
    rows = LN.learned_sections(activations, df, recordings).orderBy("section_index").collect()
    assert [(r.start_seconds, r.end_seconds, r.label) for r in rows] == [(0.0, 3.335, "verse"), (3.335, 3.336, "mystery"), (3.336, 10.0, "chorus")]
    soft = []
    for row in logits:
        e = [math.exp(x - max(row)) for x in row]
        soft.append([x / sum(e) for x in e])
    for r in rows:
        first = min(frames - 1, round(r.start_seconds * 100))
        stop = min(frames, max(first + 1, round(r.end_seconds * 100)))
        mean = [sum(soft[f][k] for f in range(first, stop)) / (stop - first) for k in range(10)]
        best = sorted(range(10), key=lambda k: -mean[k])[:3]
        assert [h.label for h in r.label_hypotheses] == [LN.LABELS[k] for k in best]
        own = mean[LN.LABELS.index(r.label)] if r.label in LN.LABELS else max(mean)
        assert abs(r.confidence - own) < 1e-6
        assert abs(r.boundary_confidence - 1 / (1 + math.exp(-border[first]))) < 1e-6
    assert rows[-1].end_sample == 441_000


def test_ties_go_to_the_earlier_label(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.2, 0.5, 0.5],)], "p array<double>")
    got = df.select(LN.top_labels(F.col("p"), ("a", "b", "c", "d", "e"))).first()[0]
    assert [g.label for g in got] == ["b", "d", "e"]


def test_softmax_of_large_logits(spark):
    got = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(X.softmax("v")).first()[0]
    assert got == [0.5, 0.5]


def test_tempo(spark):
    beats = spark.createDataFrame([("a", 0.5 * i) for i in range(20)] + [("a", 30.0), ("b", 1.0)], "k string, seconds double")
    assert [tuple(r) for r in LN.tempo_from_beats(beats, ["k"], run=3.0).collect()] == [("a", 120)]


def test_segments_without_activations_or_recording(spark):
    names = ("whole", "silent", "unknown")
    df = spark.createDataFrame([(r, "m", i, i * 1.0, i + 1.0, "verse") for r in names for i in range(3)], schemas.SEGMENTS)
    activations = spark.createDataFrame(
        [(r, "m", i, 0.0, 0.0, 0.0, [0.0] * 10) for r in ("whole", "unknown", "alone") for i in range(300)], schemas.ACTIVATIONS
    )
    recordings = spark.createDataFrame([(r, 3.0, 100, 300) for r in ("whole", "silent", "alone")], RECORDINGS)
    rows = {(r.recording_id, r.section_index): r for r in LN.learned_sections(activations, df, recordings).collect()}
    assert set(rows) == {(r, i) for r in names for i in range(3)}
    assert all((rows["silent", i].confidence is None) and (rows["unknown", i].start_sample is None) for i in range(3))
    assert abs(rows["unknown", 2].confidence - 0.1) < 1e-9 and rows["unknown", 2].end_seconds == 3.0
    found = LN.learned_violations(activations, df, recordings).collect()
    assert {(r.recording_id, r.check) for r in found} == {
        ("silent", "missing_activations"), ("unknown", "missing_recording"), ("alone", "missing_segments")
    }
