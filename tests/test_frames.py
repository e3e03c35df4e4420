import numpy as np
import pyarrow as pa
import pytest
from audio import blocks_of, tone

from songframe.functions import signal as S
from songframe.operators import frames as FR
from songframe.operators import separation as SP

RNG = np.random.default_rng(4)


def whole_stft(x, n_fft, hop):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    starts = range(0, len(x) - n_fft + 1, hop)
    m = np.array([np.abs(np.fft.rfft(x[s : s + n_fft] * window)) / window.sum() for s in starts])
    return np.maximum(20 * np.log10(np.maximum(m, 1e-6)), -120)


def gather(df, column):
    rows = df.orderBy("frame_index").collect()
    return [r.frame_index for r in rows], np.array([r[column] for r in rows]), rows


@pytest.mark.parametrize("block", [131_072, 10_000])
def test_blocks_give_the_frames_of_the_whole(spark, block):
    left, right = RNG.normal(0, 0.1, 30_000), RNG.normal(0, 0.1, 30_000)
    blocks = blocks_of(spark, {("a", "mixture"): [left, right]}, block=block)
    mono = ((left.astype(np.float32) + right.astype(np.float32)) / 2).astype(float)
    for config in FR.DEFAULT_CONFIGS:
        index, levels, rows = gather(FR.spectrogram_frames(blocks, [config]), "magnitude_dbfs")
        want = whole_stft(mono, config.n_fft, config.hop_length)
        assert index == list(range(len(want)))
        assert np.abs(levels - want).max() < 0.05
        assert rows[0].center_seconds == config.n_fft / (2 * 44_100)


def test_tone_peaks_where_it_should(spark):
    blocks = blocks_of(spark, {("a", "mixture"): [tone(2.0, parts=((440.0, 1.0),))]})
    _, levels, _ = gather(FR.spectrogram_frames(blocks, [FR.SpectrogramConfig("t", 1024, 256)]), "magnitude_dbfs")
    mean = levels.mean(axis=0)
    assert levels.shape[1] == 513
    assert abs(mean.argmax() * 44_100 / 1024 - 440) < 44_100 / 1024
    assert -7 < mean.max() < -5.5


def test_published_frame_counts(spark):
    tracks = spark.createDataFrame([("a", "mixture", 44_100, 7_868_160, "x"), ("b", "mixture", 44_100, 900, "x")],
                                   "recording_id string, track string, sample_rate_hz int, frame_count bigint, sha256 string")
    meta = FR.spectrogram_meta(tracks)
    got = {(r.recording_id, r.config): (r.frequency_bins, r.time_frames) for r in meta.collect()}
    assert got[("a", "transient")] == (513, 30_732) and got[("a", "harmonic")] == (2_049, 7_680)
    assert got[("b", "transient")] == (513, 0)
    assert FR.short_recordings(meta).count() == 2
    assert len({r.config_sha256 for r in meta.collect()}) == 2


def test_context_from_neighbours_equals_context_from_files(spark):
    x = RNG.normal(0, 0.1, 40_000)
    full = blocks_of(spark, {("a", "mixture"): [x]}, block=16_000)
    bare = blocks_of(spark, {("a", "mixture"): [x]}, block=16_000, context=False)
    want = {r.block_index: (r.before, r.after) for r in full.collect()}
    got = {r.block_index: (r.before, r.after) for r in FR.with_context(bare).collect()}
    assert got == want


def test_filterbank():
    bank = S.log_filterbank()
    assert bank.shape == (1024, 81) and np.count_nonzero(bank) == 1_428
    assert np.allclose(bank.sum(axis=0), 1, atol=1e-6)


def test_log_band_features(spark):
    x = tone(1.0, parts=((440.0, 0.5),))
    for block in (131_072, 7_000):
        index, bands, _ = gather(FR.log_band_frames(blocks_of(spark, {("a", "bass"): [x]}, block=block)), "bands")
        assert bands.shape == (100, 81) and index == list(range(100))
        assert np.isfinite(bands).all() and (bands >= 0).all()
        padded = np.pad(x.astype(np.float32).astype(float), (1024, 1023 + 441))
        window = np.hanning(2048)
        for k in (0, 3, 57, 99):
            spectrum = np.abs(np.fft.fft(padded[k * 441 : k * 441 + 2048] * window))[:1024]
            assert np.allclose(bands[k], np.log10(1 + spectrum @ S.log_filterbank()), atol=1e-4)


def test_other_rates_are_listed_and_left_out(spark):
    blocks = blocks_of(spark, {("a", "bass"): [np.zeros(500)]}, rate=8_000).unionByName(blocks_of(spark, {("b", "bass"): [np.zeros(500)]}))
    assert {r.recording_id for r in FR.log_band_frames(blocks).collect()} == {"b"}
    assert [(r.recording_id, r.check, r.detail) for r in FR.rate_violations(blocks).collect()] == [("a", "sample_rate", "8000")]


def test_frames_wider_than_the_context_are_refused(spark):
    blocks = blocks_of(spark, {("a", "bass"): [np.zeros(500)]})
    for wide in (lambda: FR.log_band_frames(blocks, 4_098), lambda: FR.onset_chroma_frames(blocks, 4_096), lambda: FR.spectrogram_frames(blocks, [FR.SpectrogramConfig("w", 8_192, 64)])):
        with pytest.raises(ValueError, match="wider block context"):
            wide()
    with pytest.raises(ValueError, match="has to hold"):
        FR.with_context(blocks, 10, 10, 5)


def test_short_blocks_get_their_context(spark):
    x = RNG.normal(0, 0.1, 9_000)
    whole = blocks_of(spark, {("a", "m"): [x], ("b", "m"): [x]}, block=3_000)
    pieces = blocks_of(spark, {("a", "m"): [x]}, block=700, context=False).unionByName(blocks_of(spark, {("b", "m"): [x]}, block=3_000, context=False))
    got = FR.with_context(pieces, 2_048, 2_500, 3_000)
    rows = lambda df: {(r.recording_id, r.block_index): (r.start_sample, r.samples, r.before, [c[:2_500] for c in r.after]) for r in df.collect()}
    assert rows(got) == rows(whole)


def test_stacking_and_shapes(spark):
    x = tone(0.5)
    tracks = {("a", s): [x] for s in FR.STEM_ORDER} | {("b", s): [x if s != "bass" else x[:9_000]] for s in FR.STEM_ORDER}
    bands = FR.log_band_frames(blocks_of(spark, tracks))
    shapes = FR.feature_shapes(bands)
    recordings = spark.createDataFrame([("a", len(x)), ("b", len(x))], "recording_id string, frame_count bigint")
    assert [r.recording_id for r in FR.stem_shape_violations(shapes, recordings).collect()] == ["b"]
    stacked = FR.stack_stems(bands).filter("recording_id = 'a'").collect()
    assert len(stacked) == 50 and len(stacked[0].stems) == 4 and len(stacked[0].stems[0]) == 81


def test_onset_and_chroma_do_not_depend_on_blocks(spark):
    x = tone(0.6, parts=((440.0, 0.5),)) * (np.arange(26_460) > 12_000)
    a = FR.onset_chroma_frames(blocks_of(spark, {("a", "mixture"): [x]}))
    b = FR.onset_chroma_frames(blocks_of(spark, {("a", "mixture"): [x]}, block=5_120))
    ia, oa, rows = gather(a, "onset")
    ib, ob, _ = gather(b, "onset")
    assert ia == ib == list(range(1 + len(x) // 512))
    assert np.allclose(oa, ob, atol=1e-4)
    assert abs(int(oa.argmax()) - 12_000 // 512) <= 2
    assert int(np.argmax(rows[-5].chroma)) == 9  # A


def test_onset_from_stored_frames(spark):
    rows = [("a", "mixture", "c", i, [float(i % 3), 1.0]) for i in range(10)]
    frames = spark.createDataFrame(rows, "recording_id string, track string, config string, frame_index bigint, magnitude_dbfs array<float>")
    got = [r.onset for r in FR.onset_from_frames(frames, run=4).orderBy("frame_index").collect()]
    assert got == [0.0] + [0.5 if i % 3 else 0.0 for i in range(1, 10)]


def test_downmix_and_pcm(spark):
    df = spark.createDataFrame([([[16384, -32768], [0, 0]],)], "s array<array<int>>")
    from pyspark.sql import functions as F
    scaled = SP.pcm_to_float("s", F.lit(16))
    assert df.select(scaled).first()[0] == [[0.5, -1.0], [0.0, 0.0]]
    assert df.select(SP.downmix(scaled)).first()[0] == [0.25, -0.5]


def test_short_blocks_are_handed_out_before_their_arrays_pile_up():
    rows, sizes = FR._Rows(pa.schema([("x", pa.int64())])), []
    for i in range(5_000):
        rows.add([pa.array([i])], 1)
        if rows.full():
            sizes.append(rows.take().num_rows)
    assert sizes and max(sizes) <= 1_000 and sum(sizes) + len(rows.parts) == 5_000
