"""Array helpers that run inside Arrow tasks: windows, frames, spectra, filterbanks.

They see one waveform block at a time; Spark decides where blocks live.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the 100 frames-per-second log-band features.
BAND_RATE = 44_100
BAND_FRAME = 2_048
BAND_HOP = 441
BAND_LOW_HZ = 30.0
BAND_HIGH_HZ = 17_000.0
TUNING_HZ = 440.0
BAND_COUNT = 81


def periodic_hann(size: int, dtype=np.float32) -> np.ndarray:
    return np.hanning(size + 1)[:-1].astype(dtype)


def symmetric_hann(size: int, dtype=np.float32) -> np.ndarray:
    return np.hanning(size).astype(dtype)


def log_filterbank(
    frame: int = BAND_FRAME,
    rate: int = BAND_RATE,
    low_hz: float = BAND_LOW_HZ,
    high_hz: float = BAND_HIGH_HZ,
) -> np.ndarray:
    """Unit-sum triangles between semitone-spaced bins, as a (frame/2, bands) matrix."""
    bins, spacing = frame // 2, rate / frame
    first, last = (int(f(12 * np.log2(hz / TUNING_HZ))) for f, hz in ((np.floor, low_hz), (np.ceil, high_hz)))
    semitones = TUNING_HZ * np.exp2(np.arange(first, last + 1) / 12.0)
    wanted = semitones[(semitones >= low_hz) & (semitones <= high_hz)]
    nearest = np.floor(wanted / spacing + 0.5).astype(int)
    edges = np.unique(np.clip(nearest, 0, bins - 1))
    position = np.arange(bins)[:, None]
    start, peak, stop = edges[:-2], edges[1:-1], edges[2:]
    rising = (position - start) / (peak - start)
    falling = (stop - position) / (stop - peak)
    shape = np.where(position < peak, rising, falling)
    shape = np.where((position >= start) & (position < stop), shape, 0.0)
    return (shape / shape.sum(axis=0)).astype(np.float32)


def chroma_map(n_fft: int, rate: int) -> np.ndarray:
    """(bins, 12) matrix that adds each bin to its nearest pitch class, C first; DC is left out."""
    frequency = np.arange(1, n_fft // 2 + 1) * rate / n_fft
    pitch = np.mod(np.rint(12 * np.log2(frequency / TUNING_HZ)) + 9, 12).astype(int)
    matrix = np.zeros((n_fft // 2 + 1, 12), dtype=np.float32)
    matrix[np.arange(1, n_fft // 2 + 1), pitch] = 1.0
    return matrix


def mono(channels) -> np.ndarray:
    """Mean over channels in single precision."""
    if len(channels) == 1:
        return channels[0]
    return np.mean(np.stack(channels), axis=0, dtype=np.float32)


def cut_frames(signal: np.ndarray, origin: int, first: int, count: int, hop: int, size: int) -> np.ndarray:
    """``count`` frames from absolute sample ``first`` on; samples outside the signal are zero.

    ``origin`` is the absolute number of ``signal[0]``.
    """
    if count <= 0:
        return np.zeros((0, size), dtype=np.float32)
    left = first - origin
    right = left + (count - 1) * hop + size
    pad_left, pad_right = max(0, -left), max(0, right - len(signal))
    if pad_left or pad_right:
        signal = np.pad(signal, (pad_left, pad_right))
    begin = left + pad_left
    view = np.lib.stride_tricks.sliding_window_view(signal, size)
    return view[begin : begin + (count - 1) * hop + 1 : hop]


def magnitude(frames: np.ndarray, window: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Scaled spectrum magnitude in the window's precision."""
    spectrum = np.fft.rfft(frames * window, axis=1)
    return np.abs(spectrum) * window.dtype.type(scale)


def level_db(values: np.ndarray, minimum_db: float) -> np.ndarray:
    floor = values.dtype.type(10.0 ** (minimum_db / 20.0))
    return np.maximum(20.0 * np.log10(np.maximum(values, floor)), minimum_db)
