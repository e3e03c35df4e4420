"""Retrieved intervals against whole signals, and what the reader skips."""

import random

from pyspark.sql import functions as F

from songframe.operators import retrieval as RT
from songframe.sources.ordered_store import OrderedTable, save_ordered

SCHEMA = "recording_id string, track string, block_index bigint, start_sample bigint, samples array<array<float>>"


def stored(spark, path, songs, size=7, files=4):
    """Blocks of ``songs`` (id to list of samples), the second track being negative."""
    rows = [
        (song, track, i, at, [[float(sign * x) for x in signal[at : at + size]]])
        for song, signal in songs.items() for track, sign in (("mixture", 1), ("bass", -1)) for i, at in enumerate(range(0, len(signal), size))
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("length", RT.stored_length())
    return save_ordered(df, str(path), files)


def test_any_interval(spark, tmp_path):
    rng = random.Random(3)
    songs = {f"r{i}": [rng.randint(0, 99) for _ in range(rng.randint(1, 90))] for i in range(12)}
    table = stored(spark, tmp_path / "blocks", songs)
    asked = []
    for n in range(60):
        song = rng.choice([*songs, "unknown"])
        a = rng.randint(0, 95)
        asked.append((n, song, a, a + rng.randint(0, 40)))
    requests = spark.createDataFrame(asked, "interval_id bigint, recording_id string, start_sample bigint, end_sample bigint")
    got = {}
    for r in RT.samples_in(table, requests).collect():
        for i, x in enumerate(r.samples[0]):
            assert (r.interval_id, r.track, r.start_sample + i) not in got
            got[r.interval_id, r.track, r.start_sample + i] = x
    want = {
        (n, track, i): float(sign * songs[song][i])
        for n, song, a, b in asked if song in songs for track, sign in (("mixture", 1), ("bass", -1)) for i in range(a, min(b, len(songs[song])))
    }
    assert got == want


def test_order_over_files_and_pruning(spark, tmp_path):
    songs = {f"r{i:03d}": list(range(60)) for i in range(40)} | {"r020": list(range(3_000))}
    table = stored(spark, tmp_path / "blocks", songs, files=8)
    ranges = sorted((tuple(r["first"]), tuple(r["last"]), r["rows"], r.order) for r in table.ranges().collect())
    assert len(ranges) == 8 and all(r[3] == ["recording_id", "start_sample"] for r in ranges)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum("r020" in (r[0][0], r[1][0]) or r[0][0] < "r020" < r[1][0] for r in ranges) > 1  # the long one is split
    requests = spark.createDataFrame([("a", "r003", 10, 20), ("b", "r020", 2_900, 2_950)], "interval_id string, recording_id string, start_sample bigint, end_sample bigint")
    files = table.files_for(requests, "start_sample", "end_sample")
    assert 1 <= len(files) <= 4
    plan = RT.samples_in(table, requests)._jdf.queryExecution().executedPlan().toString()
    assert "In(recording_id" in plan and "GreaterThan(start_sample" in plan
    assert table.read(requests, "start_sample", "end_sample").count() < table.read().count() / 2
    none = requests.withColumn("recording_id", F.lit("zzz"))
    assert RT.samples_in(table, none).count() == 0 and RT.samples_in(table, requests.limit(0)).count() == 0


def test_rows_of_a_file_are_sorted(spark, tmp_path):
    table = stored(spark, tmp_path / "blocks", {f"r{i}": list(range(50)) for i in range(9)}, files=3)
    for r in OrderedTable(spark, table.path).ranges().collect():
        rows = [(x.recording_id, x.start_sample) for x in spark.read.parquet(r.file).collect()]
        assert rows == sorted(rows) and rows[0] == tuple(r["first"]) and rows[-1] == tuple(r["last"])


def test_beats_and_sections(spark):
    rng = random.Random(5)
    beats = [("a", i, rng.randint(0, 4_000) / 10) for i in range(200)]
    sections = [("a", i, i * 50.0, i * 50.0 + 50.0 + (i == 3) * 100) for i in range(8)]
    asked = [(i, "a", x := rng.randint(0, 4_000) / 10, x + rng.randint(0, 900) / 10) for i in range(30)] + [(99, "b", 0.0, 5.0)]
    requests = spark.createDataFrame(asked, "interval_id bigint, recording_id string, start_seconds double, end_seconds double")
    recordings = spark.createDataFrame([("a", 10, 5_000)], "recording_id string, sample_rate_hz int, frame_count bigint")
    out = RT.retrieve(
        requests, recordings, beats=spark.createDataFrame(beats, "recording_id string, beat_index bigint, seconds double"),
        sections=spark.createDataFrame(sections, "recording_id string, section_index bigint, start_seconds double, end_seconds double"),
    )
    assert sorted((r.interval_id, r.beat_index) for r in out.beats.collect()) == sorted((n, i) for n, s, a, b in asked for _, i, x in beats if s == "a" and a <= x < b)
    want = sorted((n, i, max(a, x), min(b, y)) for n, s, a, b in asked for _, i, x, y in sections if s == "a" and min(b, y) > max(a, x))
    assert sorted((r.interval_id, r.section_index, r.inside_start, r.inside_end) for r in out.sections.collect()) == want
    assert out.samples is None and out.frames.count() == len(asked)
    assert out.frames.filter("interval_id = 99 and start_sample is not null").count() == 0
