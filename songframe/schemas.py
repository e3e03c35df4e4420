"""Table schemas shared by sources, operators and tests."""

from __future__ import annotations

CATALOG = (
    "track_id bigint, title string, artist_id bigint, artist string, album_id bigint, album string, "
    "genre_top string, metadata_duration_seconds bigint, license string, license_url string, "
    "archive_member string, dataset_url string, local_path string, bytes bigint, sha256 string, "
    "decoded_duration_seconds double"
)

RECORDINGS = (
    "recording_id string, source struct<path:string,bytes:bigint,sha256:string>, "
    "canonical struct<path:string,bytes:bigint,sha256:string,channels:int,sample_rate_hz:int,"
    "sample_width_bytes:int,frame_count:bigint,duration_seconds:double,compression_type:string>, "
    "conversion struct<config:struct<sample_rate_hz:int,channels:int,codec:string,"
    "sample_width_bytes:int>,tool_version:string>"
)

# One row holds every channel of one block of one track, together with the samples that surround
# the block. Overlapping frames can then be cut without moving neighbouring blocks.
WAVEFORM_BLOCKS = (
    "recording_id string, track string, block_index bigint, start_sample bigint, "
    "sample_rate_hz int, before array<array<float>>, samples array<array<float>>, "
    "after array<array<float>>"
)

SPECTROGRAM_FRAMES = (
    "recording_id string, track string, config string, frame_index bigint, "
    "center_seconds double, magnitude_dbfs array<float>"
)

SPECTROGRAM_META = (
    "recording_id string, track string, config string, n_fft int, hop_length int, window string, "
    "minimum_db double, config_sha256 string, sample_rate_hz int, waveform_samples bigint, "
    "frequency_bins int, time_frames bigint, parent_sha256 string"
)

LOG_BAND_FRAMES = "recording_id string, track string, frame_index bigint, bands array<float>"

STEMS = (
    "recording_id string, stem string, path string, bytes bigint, sha256 string, "
    "sample_rate_hz int, frame_count bigint, channels int, duration_seconds double, "
    "peak_absolute_amplitude double"
)

BEATS = (
    "recording_id string, hypothesis_id string, beat_index bigint, seconds double, "
    "is_downbeat boolean"
)

SECTIONS = (
    "recording_id string, hypothesis_id string, section_index bigint, start_seconds double, "
    "end_seconds double, label string, label_kind string, confidence double, notes string"
)

ACTIVATIONS = (
    "recording_id string, model string, frame bigint, beat_logit float, downbeat_logit float, "
    "boundary_logit float, label_logits array<float>"
)

SEGMENTS = (
    "recording_id string, model string, segment_index bigint, start double, end double, label string"
)

CORRECTION_SECTIONS = (
    "array<struct<start_seconds:double,end_seconds:double,label:string,confidence:double,notes:string>>"
)

CORRECTIONS = (
    "correction_id string, recording_id string, schema string, base_manifest_sha256 string, "
    f"annotator string, created_at string, sections {CORRECTION_SECTIONS}"
)

VIOLATIONS = "recording_id string, stage string, check string, subject string, severity string, detail string"

# Block geometry. A block is a multiple of both spectrogram hops.
BLOCK_SAMPLES = 131_072
CONTEXT_BEFORE = 2_048
CONTEXT_AFTER = 4_096
