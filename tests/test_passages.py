import random

import pytest

from songframe.operators import passages as PS

SECTIONS = "recording_id string, hypothesis_id string, section_index bigint, start_seconds double, end_seconds double, label string"
BEATS = "recording_id string, hypothesis_id string, seconds double"


def loop(start, end, beats, n, minimum):
    """The definition, one section at a time."""
    cuts = [start]
    for i, beat in enumerate([b for b in beats if start < b < end], start=1):
        if i % n == 0 and beat - cuts[-1] >= minimum:
            cuts.append(beat)
    if len(cuts) > 1 and end - cuts[-1] < minimum:
        cuts.pop()
    return cuts + [end]


def run(spark, sections, beats, n, minimum):
    out = PS.passage_cuts(
        spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(beats, BEATS), n, minimum
    ).select("recording_id", "section_index", "passage_index", "start_seconds", "end_seconds")
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("n,minimum", [(2, 1.0), (8, 4.0), (1, 0.25)])
def test_random_sections_match_the_loop(spark, n, minimum):
    rng = random.Random(n)
    sections, beats, want = [], [], []
    for r in range(40):
        at, spans = 0.0, []
        for _ in range(rng.randint(1, 5)):
            length = rng.choice([0.5, 3.0, 20.0, 70.0, 200.0, 900.0])
            spans.append((at, at + length))
            at += length
        mine = sorted({round(rng.uniform(0, at), rng.choice([1, 3])) for _ in range(int(at * rng.choice([0, 0.3, 2, 5])))})
        beats += [(str(r), "h", b) for b in mine]
        index = 0
        for i, (start, end) in enumerate(spans):
            sections.append((str(r), "h", i, start, end, "L"))
            cuts = loop(start, end, mine, n, minimum)
            for a, b in zip(cuts, cuts[1:]):
                want.append((str(r), i, index, a, b))
                index += 1
    assert run(spark, sections, beats, n, minimum) == sorted(want)


def test_runs_of_one_very_long_section_join_up(spark, monkeypatch):
    """Short runs force the chain to cross many run edges."""
    monkeypatch.setattr(PS, "RUN_MINIMUMS", 3)
    monkeypatch.setattr(PS, "MAX_RUNS", 1_000_000)
    rng = random.Random(5)
    mine = sorted({round(rng.uniform(0, 3_000), 2) for _ in range(4_000)})
    want = loop(0.0, 3_000.0, mine, 1, 1.7)
    got = run(spark, [("a", "h", 0, 0.0, 3_000.0, "L")], [("a", "h", b) for b in mine], 1, 1.7)
    assert [g[3:] for g in sorted(got, key=lambda g: g[2])] == list(zip(want, want[1:]))


def test_edges(spark):
    sections = [("a", "h", 0, 0.0, 10.0, "L"), ("b", "h", 0, 0.0, 3.0, "L"), ("c", "h", 0, 0.0, 9.0, "L"), ("d", "h", 0, 0.0, 8.0, "L")]
    beats = [("a", "h", 0.0), ("a", "h", 4.0), ("a", "h", 10.0), ("b", "h", 1.0), ("c", "h", 4.0), ("c", "h", 8.0), ("d", "h", 3.0), ("d", "h", 3.5)]
    got = {}
    for r, _, _, start, end in run(spark, sections, beats, 1, 4.0):
        got.setdefault(r, []).append((start, end))
    assert got["a"] == [(0.0, 4.0), (4.0, 10.0)]  # beats on the edges do not count
    assert got["b"] == [(0.0, 3.0)]  # shorter than the minimum, kept whole
    assert got["c"] == [(0.0, 4.0), (4.0, 9.0)]  # the last cut would leave one second
    assert got["d"] == [(0.0, 8.0)]  # candidates closer than the minimum


def test_passages_on_samples_frames_and_stems(spark):
    """Worked out by hand: every third beat cuts, the one at 6.6 s would leave less than half a second."""
    sections = spark.createDataFrame([("a", "h", 0, 0.0, 3.0, "ride"), ("a", "h", 1, 3.0, 7.0, "coda")], SECTIONS)
    beats = spark.createDataFrame([("a", "h", 0.6 * i) for i in range(1, 12)], BEATS)
    recordings = spark.createDataFrame([("a", 50, 350, 7.0)], "recording_id string, sample_rate_hz int, frame_count bigint, duration_seconds double")
    # centres at 0.16 s and every half second from there, fourteen of them
    axis = spark.createDataFrame([("a", "mixture", "wide", 16, 25, 50, 14)], "recording_id string, track string, config string, n_fft int, hop_length int, sample_rate_hz int, time_frames bigint")
    stems = spark.createDataFrame([("a", s, f"/{s}", s[0]) for s in ("vocals", "drums", "bass", "other", "choir")], "recording_id string, stem string, path string, sha256 string")
    built = PS.build_passages(sections, beats, recordings, axis, stems, 3, 0.5)
    got = [
        (r.passage_index, r.section_label, round(r.start_seconds, 6), r.start_sample, r.end_sample, *r.spectrogram_frames["wide"])
        for r in built.orderBy("passage_index").collect()
    ]
    assert got == [
        (0, "ride", 0.0, 0, 90, 0, 4),
        (1, "ride", 1.8, 90, 150, 4, 6),
        (2, "coda", 3.0, 150, 240, 6, 10),
        (3, "coda", 4.8, 240, 350, 10, 14),
    ]
    # the fifth stem is none that passages carry
    assert {k: v.sha256 for k, v in built.first().aligned_stems.items()} == {"bass": "b", "drums": "d", "other": "o", "vocals": "v"}


def test_violations_of_passages(spark):
    durations = spark.createDataFrame([("a", "h", 9.0)], "recording_id string, hypothesis_id string, duration_seconds double")

    def checks(*edges):
        rows = [("a", "h", i, start, end) for i, (start, end) in enumerate(edges)]
        table = spark.createDataFrame(rows, "recording_id string, hypothesis_id string, passage_index int, start_seconds double, end_seconds double")
        return sorted(r.check for r in PS.passage_violations(table, durations).collect())

    assert checks((0.0, 4.0), (4.0, 9.0)) == []
    assert len(checks((0.0, 4.0), (5.0, 9.0))) == 1
    assert checks((1e-7, 4.0), (4.0, 9.0)) == ["nonzero_start"]


def test_bad_settings():
    with pytest.raises(ValueError):
        PS.check_settings(beats_per_passage=-3, minimum_seconds=2.5)
    with pytest.raises(ValueError, match="minimum_seconds"):
        PS.check_settings(beats_per_passage=4, minimum_seconds=float("nan"))
    PS.check_settings(beats_per_passage=4, minimum_seconds=0.1)
