"""Column expressions: sample/frame arithmetic, levels, labels, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timeline tolerance in seconds, smallest positive double step, id pattern.
TOLERANCE = 1e-6
DOUBLE_EPSILON = 2.0**-52
RECORDING_ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
LICENSE = "CC0 1.0 Universal"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def let(value, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside a higher-order function every expression is evaluated again per element; a one-element
    array makes the value a variable of the function instead.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def half_even(value) -> Column:
    """Round to the nearest whole number, halves to even."""
    return F.rint(_col(value)).cast("bigint")


def start_sample(seconds, rate) -> Column:
    return half_even(_col(seconds) * _col(rate))


def end_sample(seconds, rate, frame_count) -> Column:
    """End of an interval in samples, never past the recording."""
    return F.least(_col(frame_count).cast("bigint"), start_sample(seconds, rate))


def frame_center(index, n_fft, hop, rate) -> Column:
    """Centre of an analysis window in seconds."""
    return (_col(n_fft) / 2.0 + _col(index) * _col(hop)) / _col(rate).cast("double")


def frames_before(seconds, n_fft, hop, rate, frames) -> Column:
    """How many frame centres lie strictly before ``seconds``.

    The algebraic guess can be off by one where the centre is not exact in binary, so the four
    neighbouring centres are tested with the very expression that defines them.
    """
    t, n_fft, hop, rate = _col(seconds), _col(n_fft), _col(hop), _col(rate)
    guess = F.ceil((t * rate - n_fft / 2.0) / hop)
    tests = [
        F.when(frame_center(guess + F.lit(step), n_fft, hop, rate) < t, 1).otherwise(0)
        for step in (-2, -1, 0, 1)
    ]
    count = guess - F.lit(2) + reduce(lambda a, b: a + b, tests)
    return F.greatest(F.lit(0), F.least(_col(frames), count)).cast("bigint")


def stft_frame_count(samples, n_fft, hop) -> Column:
    """Frames that fit without padding; none when the recording is shorter than the window."""
    samples, n_fft, hop = _col(samples), _col(n_fft), _col(hop)
    return F.when(samples < n_fft, F.lit(0)).otherwise(
        F.floor((samples - n_fft) / hop) + 1
    ).cast("bigint")


def frame_to_seconds(frame, hop, rate) -> Column:
    return _col(frame) * _col(hop) / _col(rate).cast("double")


def seconds_to_frame(seconds, hop, rate) -> Column:
    return F.floor(_col(seconds) * _col(rate) / _col(hop)).cast("bigint")


def clip_index(index, size) -> Column:
    """Keep an index on its axis."""
    return F.greatest(F.lit(0), F.least(_col(size) - F.lit(1), _col(index))).cast("bigint")


def clamp(value, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(value), F.lit(high)), F.lit(low))


def dbfs(magnitude, minimum_db) -> Column:
    """Level in dB with a floor."""
    floor_db = _col(minimum_db)
    floor = F.pow(F.lit(10.0), floor_db / 20.0)
    return F.greatest(20.0 * F.log10(F.greatest(_col(magnitude), floor)), floor_db)


def log_compress(value) -> Column:
    return F.log10(F.lit(1.0) + _col(value))


def pcm_scale(bits) -> Column:
    """Full scale of an integer sample: the larger magnitude of the type's two ends."""
    bits = _col(bits)
    return F.when(bits == 8, F.lit(255.0)).otherwise(F.pow(F.lit(2.0), bits - 1))


def sigmoid(value) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(value)))


def softmax(vector) -> Column:
    """Probabilities over an array of logits, shifted by the largest logit."""

    def spread(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(weights, lambda x: x / t))

    return let(
        F.array_max(_col(vector)).cast("double"),
        lambda top: let(F.transform(_col(vector), lambda x: F.exp(x.cast("double") - top)), spread),
    )


def group_letter(group) -> Column:
    return F.concat(F.lit("section_"), F.chr(_col(group).cast("bigint") + F.lit(65)))


def functional_label(label) -> Column:
    """Spell out the one abbreviated label of the learned vocabulary."""
    return F.when(_col(label) == "inst", F.lit("instrumental")).otherwise(_col(label))


def stripped(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def recording_id(supplied, digest) -> Column:
    """The supplied id, or the start of the content's digest where none or an empty one is given."""
    return F.coalesce(F.nullif(_col(supplied), F.lit("")), F.substring(_col(digest), 1, 16))


def is_safe_id(value) -> Column:
    return _col(value).rlike(RECORDING_ID_PATTERN)


def is_power_of_two(value) -> Column:
    value = _col(value)
    return (value > 0) & (value.bitwiseAND(value - F.lit(1)) == 0)


def config_digest(**fields) -> Column:
    """SHA-256 of the configuration as JSON with its keys in name order."""
    ordered = [_col(fields[name]).alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def section_count(duration, frames, target_seconds: float = 20.0) -> Column:
    """How many spans a recording is cut into: one per target length, from 2 to 12."""
    wanted = F.greatest(F.lit(2), F.least(F.lit(12), half_even(_col(duration) / F.lit(target_seconds))))
    return F.least(wanted, _col(frames)).cast("bigint")


def group_count(sections) -> Column:
    """How many similarity groups the spans fall into: from 1 to 4."""
    return F.least(F.lit(4), F.greatest(F.lit(1), half_even(F.sqrt(_col(sections))))).cast("bigint")


def mean_vector(vector, size: int) -> Column:
    """Element-wise mean of fixed-size vectors as one partially aggregated column."""
    return F.array(*[F.avg(F.get(_col(vector), F.lit(i))) for i in range(size)])
