import numpy as np
from audio import blocks_of
from pyspark.sql import functions as F

from songframe.operators import beats as BT
from songframe.operators import structure as ST

RNG = np.random.default_rng(8)


def cut_by_trying(weights, sums, spans):
    runs = [[i] for i in range(len(weights))]

    def price(a, b):
        wa, wb = weights[a].sum(), weights[b].sum()
        gap = sums[a].sum(0) / wa - sums[b].sum(0) / wb
        return wa * wb / (wa + wb) * float(gap @ gap)

    while len(runs) > spans:
        best = min(range(len(runs) - 1), key=lambda i: price(runs[i], runs[i + 1]))
        runs[best : best + 2] = [runs[best] + runs[best + 1]]
    return [r[0] for r in runs]


def test_neighbour_merging_matches_exhaustive_search():
    for _ in range(30):
        n = int(RNG.integers(3, 60))
        weights = RNG.integers(1, 5, n).astype(float)
        sums = RNG.normal(0, 1, (n, 4)) * weights[:, None]
        for spans in (1, 2, min(7, n)):
            assert ST.merge_neighbours(weights, sums, spans).tolist() == cut_by_trying(weights, sums, spans)


def test_segments_in_spark(spark):
    levels = [0.0] * 40 + [5.0] * 25 + [1.0] * 35
    rows = [("a", i, [float(v), float(-v)]) for i, v in enumerate(levels)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_index bigint, v array<float>")
    spans = spark.createDataFrame([("a", 3)], "recording_id string, span_count bigint")
    assert sorted(r.frame_index for r in ST.segment_frames(frames, "v", 2, spans).collect()) == [0, 40, 65]


def test_long_recordings_are_averaged_into_cells(spark, monkeypatch):
    monkeypatch.setattr(ST, "MAX_CELLS", 50)
    levels = [0.0] * 400 + [5.0] * 200
    frames = spark.createDataFrame([("a", i, [v]) for i, v in enumerate(levels)], "recording_id string, frame_index bigint, v array<float>")
    spans = spark.createDataFrame([("a", 2)], "recording_id string, span_count bigint")
    starts = sorted(r.frame_index for r in ST.segment_frames(frames, "v", 1, spans).collect())
    assert starts[0] == 0 and abs(starts[1] - 400) <= 12


def test_groups_are_numbered_by_appearance():
    vectors = np.array([[0.0, 0], [5, 5], [0.1, 0], [5, 5.1], [9, 0]])
    assert ST.similar_groups(vectors, 3).tolist() == [0, 1, 0, 1, 2]
    assert ST.similar_groups(vectors[:1], 1).tolist() == [0]


def test_beats_of_a_click_track():
    onset = np.zeros(3_000)
    onset[7::43] = 1.0
    beats = BT.follow_beats(onset + RNG.random(3_000) * 0.05, 43)
    assert len(beats) > 60 and (np.diff(beats)[2:-2] == 43).mean() > 0.95
    assert set((beats[5:-5] - 7) % 43) == {0}
    assert BT.follow_beats(np.zeros(500), 43).size == 0


def test_windows_do_not_change_the_tempo_or_tear_the_beats(spark, monkeypatch):
    onset = np.zeros(4_000)
    onset[10::40] = 1.0
    frames = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(onset)], "recording_id string, frame_index bigint, onset double")
    rate = 80.0
    whole = ST.estimate_tempo(frames, rate).first()
    monkeypatch.setattr(ST, "WINDOW_FRAMES", 1_000)
    monkeypatch.setattr(ST, "WINDOW_CONTEXT", 300)
    tempo = ST.estimate_tempo(frames, rate)
    parts = tempo.first()
    assert whole.period_frames == parts.period_frames == 40 and parts.tempo_bpm == 120.0
    beats = ST.track_beats(frames, tempo, rate).orderBy("beat_index").collect()
    assert [b.beat_index for b in beats] == list(range(len(beats)))
    gaps = np.diff([b.frame_index for b in beats])
    assert len(beats) >= 95 and (gaps == 40).mean() > 0.95


def test_silence_has_no_tempo(spark):
    frames = spark.createDataFrame([("a", i, 0.0) for i in range(500)], "recording_id string, frame_index bigint, onset double")
    tempo = ST.estimate_tempo(frames, 80.0)
    assert tempo.first().tempo_bpm is None and ST.track_beats(frames, tempo, 80.0).count() == 0


def test_downbeats(spark):
    rows = [("a", i, 1.0 + (i % 4 == 2)) for i in range(10)] + [("b", i, 1.0) for i in range(8)] + [("c", i, 1.0) for i in range(3)]
    beats = spark.createDataFrame(rows, "k string, beat_index bigint, onset double")
    phases = {r.k: r.downbeat_phase for r in ST.downbeat_phase(beats, ["k"]).collect()}
    assert phases == {"a": 2, "b": 0, "c": None}
    marked = ST.mark_downbeats(beats, ["k"]).filter("is_downbeat")
    assert sorted((r.k, r.beat_index) for r in marked.collect()) == [("a", 2), ("a", 6), ("b", 0), ("b", 4)]


def test_equal_means_of_decimals_tie_whatever_the_order(spark):
    # 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1 in doubles; 1.1 is the mean of 0.7, 1.5 and of 1.0, 1.1, 1.2
    tied = [("a", 4 * i + phase, x) for phase, xs in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (0.2, 0.3, 0.1))) for i, x in enumerate(xs)]
    tied += [("b", 4 * i + phase, x) for phase, xs in ((0, (0.7, 1.5)), (1, (1.2, 1.1, 1.0)), (2, (-3.5, None))) for i, x in enumerate(xs)]
    tied += [("c", i, -x) for i, x in enumerate((0.5, 0.4, 0.4, 0.6))] + [("d", i, x) for i, x in enumerate((1e-9, 3e-9, 1e300, 2.0))] + [("e", i, None) for i in range(4)]
    for rows in (tied, tied[::-1]):
        beats = spark.createDataFrame(rows, "k string, beat_index bigint, onset double").coalesce(1)
        assert {r.k: r.downbeat_phase for r in ST.downbeat_phase(beats, ["k"]).collect()} == {"a": 1, "b": 0, "c": 1, "d": 2, "e": 0}


def test_onsets_at_beats_stay_on_the_axis(spark):
    frames = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "recording_id string, frame_index bigint, onset double")
    beats = spark.createDataFrame([("a", 2), ("a", 9), ("a", -3)], "recording_id string, frame_index bigint")
    assert sorted(r.onset for r in ST.attach_onsets(beats, frames).collect()) == [0.0, 2.0, 4.0]


def test_baseline(spark):
    rate, seconds = 44_100, 48
    t = np.arange(rate * seconds) / rate
    hz = np.where(t < 20, 261.6, np.where(t < 34, 392.0, 261.6))
    clicks = (np.mod(t, 0.5) < 0.02) * RNG.normal(0, 0.5, t.size)
    x = 0.3 * np.sin(2 * np.pi * hz * t) + clicks
    recordings = spark.createDataFrame([("a", rate, len(x), float(seconds))], "recording_id string, sample_rate_hz int, frame_count bigint, duration_seconds double")
    found = ST.baseline_structure(blocks_of(spark, {("a", "mixture"): [x]}), recordings)
    structure = found.structures.first()
    assert abs(structure.tempo_bpm - 120) < 3 and structure.downbeat_phase in (0, 1, 2, 3)
    beats = found.beats.orderBy("beat_index").collect()
    assert 80 <= len(beats) <= 100 and 18 <= sum(b.is_downbeat for b in beats) <= 25
    sections = found.sections.orderBy("section_index").collect()
    assert len(sections) in (2, 3) and sections[0].label == "section_A"
    aligned = ST.align_structure(found, recordings)
    assert aligned.violations.count() == 0
    assert aligned.sections.agg(F.max("end_sample")).first()[0] == len(x)


def test_backend_output_is_checked(spark):
    structures = spark.createDataFrame([("a", "h", 120.0)], "recording_id string, hypothesis_id string, tempo_bpm double")
    beats = spark.createDataFrame([("a", "h", 0, 0.5, True), ("a", "h", 1, 0.4, False), ("a", "h", 2, 2.5, True)],
                                  "recording_id string, hypothesis_id string, beat_index bigint, seconds double, is_downbeat boolean")
    sections = spark.createDataFrame([("a", "h", 0, 0.0, 1.0), ("a", "h", 1, 1.0, 2.0)],
                                     "recording_id string, hypothesis_id string, section_index bigint, start_seconds double, end_seconds double")
    recordings = spark.createDataFrame([("a", 44_100, 88_200, 2.0)], "recording_id string, sample_rate_hz int, frame_count bigint, duration_seconds double")
    aligned = ST.align_structure(ST.Hypothesis(structures, beats, sections), recordings)
    assert sorted((r.stage, r.check) for r in aligned.violations.collect()) == [("beats", "not_increasing"), ("beats", "past_end"), ("downbeats", "past_end")]
    assert [r.end_sample for r in aligned.sections.orderBy("section_index").collect()] == [44_100, 88_200]
