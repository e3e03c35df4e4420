import math

import numpy as np
import pytest
from audio import blocks_of, tone
from pyspark.sql import functions as F

from songframe.operators import separation as SP

X = tone(0.4, parts=((220.0, 0.25),)).astype(np.float32)
Y = tone(0.4, parts=((330.0, 0.5),)).astype(np.float32)


@pytest.fixture(scope="module")
def catalog(spark):
    silent = np.zeros_like(X)
    tracks = {
        "exact": {"mixture": X, "vocals": X, "drums": silent, "bass": silent, "other": silent},
        "quarter": {s: X if s == "mixture" else X / 4 for s in ("mixture", *SP.REQUIRED_STEMS)},
        "poor": {"mixture": Y, "vocals": Y / 2, "drums": silent, "bass": silent, "other": silent},
        "silent": {s: silent for s in ("mixture", *SP.REQUIRED_STEMS)},
        "short": {"mixture": X, "vocals": X, "drums": silent[:-5], "bass": silent, "other": silent},
        "nobass": {"mixture": X, "vocals": X, "drums": silent, "other": silent, "choir": silent},
    }
    flat = {(r, t): [v, v] for r, named in tracks.items() for t, v in named.items()}
    blocks = blocks_of(spark, flat, block=4_000)
    geometry = SP.track_geometry(blocks)
    return blocks, geometry


def split(catalog):
    blocks, geometry = catalog
    mixture, stems = blocks.filter("track = 'mixture'"), blocks.filter("track <> 'mixture'")
    mixtures = geometry.filter("track = 'mixture'").drop("track")
    return mixture, stems, mixtures, geometry.filter("track <> 'mixture'").withColumnRenamed("track", "stem")


def test_audit(spark, catalog):
    audit = SP.audit_separation(*split(catalog))
    metrics = {r.recording_id: r for r in audit.metrics.collect()}
    assert set(metrics) == {"exact", "quarter", "poor", "silent"}
    exact = metrics["exact"]
    assert exact.normalized_reconstruction_error == 0 and exact.within_threshold and math.isinf(exact.reconstruction_snr_db)
    assert abs(exact.peak_vocals - np.abs(X).max()) < 1e-7 and exact.peak_bass == 0
    assert abs(exact.mixture_rms - np.sqrt(np.mean(X.astype(float) ** 2))) < 1e-9
    assert metrics["quarter"].normalized_reconstruction_error < 1e-6
    poor = metrics["poor"]
    assert abs(poor.normalized_reconstruction_error - 0.5) < 1e-6 and not poor.within_threshold
    assert abs(poor.reconstruction_snr_db - 20 * math.log10(2)) < 1e-4
    assert abs(poor.maximum_absolute_residual - np.abs(Y).max() / 2) < 1e-6
    assert metrics["silent"].normalized_reconstruction_error == 0
    problems = sorted((r.recording_id, r.check, r.subject, r.severity) for r in audit.violations.collect())
    assert problems == [
        ("nobass", "missing_stem", "bass", "error"), ("nobass", "unexpected_stem", "choir", "error"),
        ("poor", "above_threshold", "reconstruction", "warn"), ("short", "frame_count", "drums", "error"),
    ]


def test_residual(spark, catalog):
    mixture, stems, _, _ = split(catalog)
    rows = SP.residual_blocks(mixture.filter("recording_id = 'poor'"), stems).orderBy("block_index").collect()
    residual = np.concatenate([np.array(r.residual) for r in rows], axis=1)
    assert np.allclose(residual[0], Y / 2) and residual.shape == (2, len(Y))


def test_loudness_round_trip(spark, catalog):
    blocks, _ = catalog
    blocks = blocks.filter("track = 'mixture'")
    stats = SP.block_loudness(blocks)
    found = {r.recording_id: r for r in stats.collect()}
    assert abs(found["poor"].reference_std - Y.astype(float).std(ddof=1)) < 1e-9
    assert found["silent"].reference_std is None
    normal = SP.normalise_blocks(blocks, stats)
    back = SP.normalise_blocks(normal, stats, inverse=True)
    rows = back.filter("recording_id = 'poor'").orderBy("block_index").collect()
    assert np.allclose(np.concatenate([r.samples[0] for r in rows]), Y, atol=1e-5)
    assert all(x is None for x in normal.filter("recording_id = 'silent'").first().samples[0])


def test_backend_contract(spark, catalog):
    blocks, _ = catalog
    mixture = blocks.filter("track = 'mixture' AND recording_id = 'poor'")
    stems = SP.run_backend(mixture, SP.even_split_backend(), {"name": "even", "version": "1"})
    assert stems.select("backend.name").distinct().first()[0] == "even"
    energies = SP.block_energies(mixture, stems)
    assert SP.reconstruction_metrics(energies).first().within_threshold


def test_stem_records(spark):
    files = spark.createDataFrame([("a", s, f"/{s}", 10, "h", 44_100, 44_100, 2) for s in SP.REQUIRED_STEMS],
        "recording_id string, stem string, path string, bytes bigint, sha256 string, sample_rate_hz int, frame_count bigint, channels int")
    peaks = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4)], "recording_id string, " + ", ".join(f"peak_{s} double" for s in SP.REQUIRED_STEMS))
    rows = {r.stem: r for r in SP.stem_records(files, peaks).collect()}
    assert rows["bass"].peak_absolute_amplitude == 0.3 and rows["bass"].duration_seconds == 1.0


def test_clamp_and_pcm_widths(spark):
    from songframe.functions import exprs as X_
    row = spark.range(1).select(X_.clamp(F.lit(3.0), -0.99, 0.99), X_.pcm_scale(F.lit(24)), X_.pcm_scale(F.lit(8))).first()
    assert tuple(row) == (0.99, 2.0**23, 255.0)


def test_blocks_that_a_side_lacks(spark, catalog):
    mixture, stems, mixtures, tracks = split(catalog)
    lost = "(recording_id = 'exact' AND track = 'bass' AND block_index = 1)"
    stems = stems.filter(f"NOT {lost}")
    mixture = mixture.filter("NOT (recording_id = 'quarter' AND block_index = 2)")
    audit = SP.audit_separation(mixture, stems, mixtures, tracks)
    assert {r.recording_id for r in audit.metrics.collect()} == {"poor", "silent"}
    found = {(r.recording_id, r.subject, r.detail) for r in audit.violations.filter("check = 'missing_block'").collect()}
    assert found == {("exact", "bass", "1"), ("quarter", "mixture", "2")}
    mixture = mixture.filter("recording_id IN ('exact', 'quarter')")
    metrics = {r.recording_id: r for r in SP.reconstruction_metrics(SP.block_energies(mixture, stems)).collect()}
    for name in ("exact", "quarter"):
        assert metrics[name].normalized_reconstruction_error is None and metrics[name].within_threshold is None
    residuals = {r.block_index: r.residual for r in SP.residual_blocks(mixture, stems).filter("recording_id = 'exact'").collect()}
    assert [k for k, v in residuals.items() if v is None] == [1] and len(residuals) > 1
