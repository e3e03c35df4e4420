"""Files: hashes, wave geometry and waveform blocks.

Listing uses Spark's binary file source without its content column, which reads no file bytes.
Content is then read in ranges, so a large file is never one row and its blocks are decoded by as
many tasks as it has blocks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe import schemas
from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.session import spread

CHUNK_BYTES = 1 << 20
# Wave format tags and the tag that points into the extension.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE

# The canonical form.
CANONICAL = {"sample_rate_hz": 44_100, "channels": 2, "codec": "pcm_s24le", "sample_width_bytes": 3}

GEOMETRY = (
    "path string, bytes bigint, channels int, sample_rate_hz int, sample_width_bytes int, "
    "frame_count bigint, duration_seconds double, compression_type string, is_float boolean, "
    "data_offset bigint, error string"
)


def _open(path: str):
    """Open a path as Spark lists it: a URI of any file system Arrow knows, or a local path."""
    if path.startswith("file:"):
        local = path[len("file:") :]
        return fs.LocalFileSystem().open_input_file("/" + local.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below a folder, found recursively by name pattern."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.col("length").alias("bytes"))
    )


def file_digests(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256), hashing each file in one-megabyte reads."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = []
            for path in batch["path"]:
                state = hashlib.sha256()
                with _open(path) as handle:
                    while chunk := handle.read(CHUNK_BYTES):
                        state.update(chunk)
                hashes.append(state.hexdigest())
            yield batch.assign(sha256=hashes)

    return files.select("path", "bytes").mapInPandas(digest, "path string, bytes bigint, sha256 string")


def _read_header(path: str) -> dict:
    with _open(path) as handle:
        size = handle.size()
        lead = handle.read(12)
        if len(lead) < 12 or lead[:4] != b"RIFF" or lead[8:12] != b"WAVE":
            raise ValueError("not a RIFF/WAVE file")
        layout, at = None, 12
        while at + 8 <= size:
            handle.seek(at)
            name, length = struct.unpack("<4sI", handle.read(8))
            if name == b"fmt ":
                body = handle.read(min(length, 40))
                tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
                if tag == EXTENSIBLE and len(body) >= 26:
                    tag = struct.unpack("<H", body[24:26])[0]
                layout = (tag, channels, rate, align, bits)
            elif name == b"data":
                if layout is None:
                    raise ValueError("data chunk before format chunk")
                tag, channels, rate, align, bits = layout
                if tag not in (PCM, FLOAT) or channels < 1 or align != channels * (bits // 8):
                    raise ValueError(f"unsupported wave format {tag} with {bits} bits")
                if (tag == PCM and bits not in (8, 16, 24, 32)) or (tag == FLOAT and bits != 32):
                    raise ValueError(f"unsupported sample width {bits}")
                usable = min(length, size - at - 8)
                return {
                    "channels": channels, "sample_rate_hz": rate, "sample_width_bytes": bits // 8,
                    "frame_count": usable // align, "is_float": tag == FLOAT, "data_offset": at + 8,
                }
            at += 8 + length + length % 2
    raise ValueError("no data chunk")


def wave_geometry(files: DataFrame) -> DataFrame:
    """Geometry of each wave file; a file that cannot be read keeps its row and says why."""

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {
            "channels": None, "sample_rate_hz": None, "sample_width_bytes": None, "frame_count": None,
            "is_float": None, "data_offset": None,
        }
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["bytes"]):
                try:
                    found = {**_read_header(path), "error": None}
                except (ValueError, OSError, struct.error) as problem:
                    found = {**empty, "error": str(problem)}
                frames, rate = found["frame_count"], found["sample_rate_hz"]
                rows.append({
                    "path": path, "bytes": size, **found,
                    "duration_seconds": round(frames / rate, 9) if rate else None,
                    "compression_type": "NONE" if found["error"] is None else None,
                })
            columns = [c.strip().split(" ")[0] for c in GEOMETRY.split(",")]
            yield pd.DataFrame(rows, columns=columns).astype(object)

    return files.select("path", "bytes").mapInPandas(inspect, GEOMETRY)


def _decode(raw: bytes, width: int, is_float: bool, channels: int) -> np.ndarray:
    """Interleaved samples to (channels, frames) in single precision, full scale at one."""
    if is_float:
        flat = np.frombuffer(raw, "<f4")
    elif width == 3:
        triples = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        # Three bytes go to the top of four, which keeps the sign.
        words = np.zeros((len(triples), 4), np.uint8)
        words[:, 1:] = triples
        flat = words.view("<i4").ravel().astype(np.float32) / np.float32(2.0**31)
    else:
        scale = {1: 255.0, 2: 2.0**15, 4: 2.0**31}[width]
        flat = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float32) / np.float32(scale)
    return np.ascontiguousarray(flat.reshape(-1, channels).T)


def waveform_blocks(tracks: DataFrame, block: int = schemas.BLOCK_SAMPLES) -> DataFrame:
    """Decode wave files into block rows that carry their surrounding samples.

    ``tracks`` is wave geometry with recording_id and track. Each file becomes one row per block
    before any sample is read; the rows are then spread evenly and each reads only its own bytes.
    """
    spans = (
        tracks.filter(F.col("error").isNull() & (F.col("frame_count") > 0))
        .withColumn(
            "block_index",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("frame_count") - 1) / F.lit(block)))),
        )
        .select(
            "recording_id", "track", "block_index", "path", "channels", "sample_rate_hz",
            "sample_width_bytes", "frame_count", "is_float", "data_offset",
        )
    )
    nested = pa.list_(pa.list_(pa.float32()))
    schema = pa.schema([
        ("recording_id", pa.string()), ("track", pa.string()), ("block_index", pa.int64()),
        ("start_sample", pa.int64()), ("sample_rate_hz", pa.int32()),
        ("before", nested), ("samples", nested), ("after", nested),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block_index"] * block
                stop = min(row["frame_count"], start + block)
                first = max(0, start - schemas.CONTEXT_BEFORE)
                last = min(row["frame_count"], stop + schemas.CONTEXT_AFTER)
                align = row["channels"] * row["sample_width_bytes"]
                with _open(row["path"]) as handle:
                    handle.seek(row["data_offset"] + first * align)
                    raw = handle.read((last - first) * align)
                whole = _decode(raw, row["sample_width_bytes"], row["is_float"], row["channels"])
                parts = np.split(whole, [start - first, stop - first], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["recording_id"]], pa.string()),
                        pa.array([row["track"]], pa.string()),
                        pa.array([row["block_index"]], pa.int64()),
                        pa.array([start], pa.int64()),
                        pa.array([row["sample_rate_hz"]], pa.int32()),
                        *[pa.array([list(p)], nested) for p in parts],
                    ],
                    schema=schema,
                )

    # Span rows are tiny and decoding is not, so their partitions must not be merged.
    return spread(spans, "path", "block_index").mapInArrow(read, schemas.WAVEFORM_BLOCKS)


def recordings(pairs: DataFrame, digests: DataFrame, geometry: DataFrame) -> DataFrame:
    """The recordings table from source and canonical files.

    ``pairs``: recording_id (may be null), source_path, canonical_path and, if known, tool_version.
    Conversion itself happens outside; this records what was converted into what.
    """
    version = F.col("tool_version") if "tool_version" in pairs.columns else F.lit(None).cast("string")
    wanted = F.struct(*[F.lit(value).alias(name) for name, value in CANONICAL.items()])
    source = digests.select(
        F.col("path").alias("source_path"), F.col("bytes").alias("sb"), F.col("sha256").alias("ss")
    )
    wave = digests.select("path", "sha256").join(geometry, "path").withColumnRenamed("path", "canonical_path")
    return (
        pairs.join(source, "source_path")
        .join(wave, "canonical_path")
        .filter((F.col("sb") > 0) & F.col("error").isNull())
        .select(
            X.recording_id("recording_id", "ss").alias("recording_id"),
            F.struct(
                F.col("source_path").alias("path"), F.col("sb").alias("bytes"), F.col("ss").alias("sha256")
            ).alias("source"),
            F.struct(
                F.col("canonical_path").alias("path"), "bytes", "sha256", "channels", "sample_rate_hz",
                "sample_width_bytes", "frame_count", "duration_seconds", "compression_type",
            ).alias("canonical"),
            F.struct(wanted.alias("config"), version.alias("tool_version")).alias("conversion"),
        )
    )


def source_violations(pairs: DataFrame, digests: DataFrame, geometry: DataFrame) -> DataFrame:
    """Sources that are missing or empty, unreadable waves and unsafe ids."""
    named = pairs.join(
        digests.select(F.col("path").alias("source_path"), F.col("bytes").alias("sb"), F.col("sha256").alias("ss")),
        "source_path", "left",
    ).withColumn("id", F.coalesce(X.recording_id("recording_id", "ss"), F.col("source_path")))
    absent = named.filter(F.coalesce("sb", F.lit(0)) == 0).select(
        F.col("id").alias("recording_id"),
        *TL.violation("ingest", "missing_or_empty_source", F.col("source_path"), F.col("sb")),
    )
    unsafe = named.filter(F.col("sb").isNotNull() & ~X.is_safe_id("id")).select(
        F.col("id").alias("recording_id"),
        *TL.violation("ingest", "unsafe_recording_id", F.col("source_path"), F.col("id")),
    )
    unreadable = (
        named.join(geometry.withColumnRenamed("path", "canonical_path"), "canonical_path")
        .filter(F.col("error").isNotNull())
        .select(
            F.col("id").alias("recording_id"),
            *TL.violation("ingest", "unreadable_wave", F.col("canonical_path"), F.col("error")),
        )
    )
    return absent.unionByName(unsafe).unionByName(unreadable)
