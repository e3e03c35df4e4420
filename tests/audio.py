"""Synthetic waves for tests."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np


def tone(seconds: float, rate: int = 44_100, parts=((440.0, 0.4),)) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return sum(level * np.sin(2 * np.pi * hz * t) for hz, level in parts)


def write_wave(path: Path, channels: list[np.ndarray], rate: int = 44_100, bits: int = 16, is_float: bool = False) -> Path:
    grid = np.stack(channels, axis=1)
    if is_float:
        raw = grid.astype("<f4").tobytes()
    else:
        whole = np.round(grid * (2 ** (bits - 1) - 1)).astype(np.int64)
        if bits == 24:
            raw = whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            raw = whole.astype({16: "<i2", 32: "<i4"}[bits]).tobytes()
    width = bits // 8 * len(channels)
    header = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 3 if is_float else 1,
                         len(channels), rate, rate * width, width, bits)
    # An odd-sized chunk before the samples has to be skipped with its padding byte.
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(header + extra + struct.pack("<4sI", b"data", len(raw)) + raw)
    return path


def blocks_of(spark, tracks: dict[tuple[str, str], list[np.ndarray]], rate: int = 44_100, block: int = 131_072,
              context: bool = True):
    """Block rows cut directly from arrays."""
    from songframe import schemas

    rows = []
    for (recording, track), channels in tracks.items():
        size = len(channels[0])
        for index in range(-(-size // block)):
            start, stop = index * block, min(size, (index + 1) * block)
            piece = lambda a, b: [np.asarray(c[max(0, a):b], np.float32).tolist() for c in channels]
            before = piece(start - schemas.CONTEXT_BEFORE, start) if context else None
            after = piece(stop, stop + schemas.CONTEXT_AFTER) if context else None
            rows.append((recording, track, index, start, rate, before, piece(start, stop), after))
    return spark.createDataFrame(rows, schemas.WAVEFORM_BLOCKS)
