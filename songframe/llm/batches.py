"""Words, shingles and polynomial hashes of many texts at once, as numpy arrays.

Words follow ``[^\\x20\\x09-\\x0D]+`` and only A-Z change case, so both can be decided on UTF-8
bytes. A prefix hash is ``C[i] = sum(v[b_j] * B**j)`` modulo 2**64 with an odd ``B``; a piece
``[s, e)`` hashes to ``(C[e] - C[s]) * B**-s``, wherever it stands. ``v`` are fixed random values per
byte and the result is mixed, so that the low bits are as good as the high ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text held as arrays at once; a longer single text is taken whole.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


VALUES = _values(7)
LOWERED = VALUES.copy()
LOWERED[ord("A") : ord("Z") + 1] = VALUES[ord("a") : ord("z") + 1]
SECOND = _values(11)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` for i below n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
                for base in (_BASE, _INVERSE)
            )
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """The prefix hashes of ``data``; one entry more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:], dtype=np.uint64)
    return out


def piece_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the pieces [start, end) of what ``prefix`` was made of."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def encoded(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and where each text starts (one entry more); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = encoded(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWERED) -> np.ndarray:
    return mix(piece_hash(prefix_hash(data, values), starts, ends) + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all runs of ``n`` neighbours with one owner, and the hashes of the runs."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)], out=prefix[1:], dtype=np.uint64)
    return at, mix(piece_hash(prefix, at, at + n))


def text_counts(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owner, minlength=rows)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` values, by doubling; one entry for each whole run."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)
