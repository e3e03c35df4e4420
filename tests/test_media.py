import hashlib

import numpy as np
from audio import tone, write_wave
from pyspark.sql import functions as F

from songframe.sources import media as M


def local(path):
    return F.regexp_replace(path, r"\Afile:/*", "/")


def test_hash_geometry_and_blocks(spark, tmp_path):
    x = tone(0.5)
    made = {
        "i16.wav": write_wave(tmp_path / "i16.wav", [x], bits=16),
        "i24.wav": write_wave(tmp_path / "i24.wav", [x, -x], bits=24),
        "i32.wav": write_wave(tmp_path / "i32.wav", [x], bits=32),
        "f32.wav": write_wave(tmp_path / "f32.wav", [x, x, x], bits=32, is_float=True),
    }
    (tmp_path / "broken.wav").write_bytes(b"RIFF0000WAVEjunk")
    (tmp_path / "empty.wav").write_bytes(b"")
    files = M.list_files(spark, str(tmp_path), "*.wav")
    digests = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in M.file_digests(files).collect()}
    for name, path in made.items():
        raw = path.read_bytes()
        assert digests[name] == (len(raw), hashlib.sha256(raw).hexdigest())
    geometry = M.wave_geometry(files)
    shape = {r.path.rsplit("/", 1)[1]: r for r in geometry.collect()}
    assert shape["broken.wav"].error
    assert "empty.wav" not in shape  # Spark lists no empty files, so they count as missing
    assert (shape["i24.wav"].channels, shape["i24.wav"].sample_width_bytes, shape["i24.wav"].frame_count) == (2, 3, len(x))
    assert shape["f32.wav"].is_float and shape["i16.wav"].duration_seconds == 0.5

    tracks = geometry.withColumn("recording_id", F.element_at(F.split("path", "/"), -1)).withColumn("track", F.lit("mixture"))
    rows = M.waveform_blocks(tracks, block=5_000).collect()
    for name, tolerance in (("i16.wav", 1e-4), ("i24.wav", 1e-6), ("i32.wav", 1e-6), ("f32.wav", 1e-6)):
        mine = sorted((r for r in rows if r.recording_id == name), key=lambda r: r.block_index)
        assert [r.start_sample for r in mine] == list(range(0, len(x), 5_000))
        joined = np.concatenate([np.array(r.samples) for r in mine], axis=1)
        assert np.abs(joined[0] - x).max() < tolerance
        second = mine[1]
        assert len(second.before[0]) == 2_048 and second.before[0] == mine[0].samples[0][-2_048:]
        assert len(mine[0].before[0]) == 0 and len(mine[-1].after[0]) == 0
        assert second.after[0] == mine[2].samples[0][:4_096]
    stereo = np.array([r for r in rows if r.recording_id == "i24.wav"][0].samples)
    assert np.allclose(stereo[0], -stereo[1])


def test_recordings_and_their_problems(spark, tmp_path):
    write_wave(tmp_path / "good.wav", [tone(0.1)] * 2, bits=24)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "junk.wav").write_bytes(b"not a wave file")
    files = M.list_files(spark, str(tmp_path))
    digests = M.file_digests(files).withColumn("path", local("path"))
    geometry = M.wave_geometry(files).withColumn("path", local("path"))
    place = lambda n: str(tmp_path / n)
    pairs = spark.createDataFrame(
        [(None, place("good.wav")), ("../escape", place("good.wav")), ("e", place("empty.wav")),
         ("gone", place("gone.wav")), ("junk", place("junk.wav"))],
        "recording_id string, source_path string",
    ).withColumn("canonical_path", F.col("source_path"))
    good = [r for r in M.recordings(pairs, digests, geometry).collect() if r.recording_id != "../escape"]
    digest = hashlib.sha256((tmp_path / "good.wav").read_bytes()).hexdigest()
    assert [r.recording_id for r in good] == [digest[:16]]
    assert good[0].conversion.config.codec == "pcm_s24le" and good[0].conversion.tool_version is None
    assert good[0].canonical.channels == 2 and good[0].canonical.sha256 == digest
    problems = sorted((r.recording_id, r.check) for r in M.source_violations(pairs, digests, geometry).collect())
    assert problems == [
        ("../escape", "unsafe_recording_id"), ("e", "missing_or_empty_source"),
        ("gone", "missing_or_empty_source"), ("junk", "unreadable_wave"),
    ]


def test_manifests_and_malformed_ones(spark, tmp_path):
    from songframe.sources import manifests as MF

    for name, text in (("a", '{"recording_id": "a", "frames": 3}'), ("b", '{"recording_id": "b", "frames": "many"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    (tmp_path / "a" / "other.txt").write_text("ignored")
    rows = MF.read_manifests(spark, str(tmp_path), "recording_id string, frames bigint").cache()
    assert sorted((r.recording_id, r.frames) for r in rows.collect()) == [("a", 3), ("b", None)]
    assert [(r.recording_id, r.check) for r in MF.malformed(rows, "ingest").collect()] == [("b", "malformed_manifest")]


def test_bucketed_blocks_join_without_a_shuffle(spark):
    import numpy as np
    from audio import blocks_of

    from songframe.operators import separation as SP
    from songframe.sources import sinks

    x = np.ones(9_000)
    blocks = blocks_of(spark, {("a", t): [x] for t in ("mixture", *SP.REQUIRED_STEMS)}, block=2_000)
    sinks.save_blocks(blocks, "blocks_by_key", 4)
    table = spark.table("blocks_by_key")
    joined = SP.side_by_side(table.filter("track = 'mixture'"), table.filter("track <> 'mixture'"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE blocks_by_key")
