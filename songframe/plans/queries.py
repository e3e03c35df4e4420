"""One query per operator, over the driver's test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.functions import signal as S
from songframe.operators import catalog as CT
from songframe.operators import corrections as CR
from songframe.operators import frames as FR
from songframe.operators import learned as LN
from songframe.operators import passages as PS
from songframe.operators import rules as RL
from songframe.operators import separation as SP
from songframe.operators import structure as ST
from songframe.operators import timeline as TL
from songframe.operators.joins import attach
from songframe.operators.lineage import lineage_violations
from songframe.operators.ordered import with_position
from songframe.operators.validation import roll_up
from songframe.plans import testbed as B
from songframe.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MIN_CHARS, MAX_CHARS = 120, 6_000
SEED, COUNT = 7, 25
VECTOR = FR.SpectrogramConfig("vector", 64, 64)
SHORT = FR.SpectrogramConfig("short", 16, 4)
BAND_RATE, BAND_FRAME, BAND_HOP, BAND_LOW, BAND_HIGH = 1_000, 64, 16, 30.0, 500.0
KEYS = ["recording_id", "hypothesis_id"]


def query(fn: Callable[[B.Tables], DataFrame]) -> Callable[[B.Tables], DataFrame]:
    REGISTRY[fn.__name__] = lambda spark, folder: fn(B.Tables(spark, folder))
    return fn


def _conv() -> F.Column:
    return F.col("recording_id").cast("bigint").alias("conv_id")


# Catalog ------------------------------------------------------------------------------------


def _eligible(t: B.Tables) -> DataFrame:
    return CT.eligible_tracks(B.catalog(t), MIN_CHARS, MAX_CHARS)


def _members(t: B.Tables) -> DataFrame:
    return CT.in_archive(_eligible(t), B.archive_members(t))


@query
def catalog_eligible(t):
    return _eligible(t).select("track_id", "archive_member", "genre_top", "artist_id", "metadata_duration_seconds", "license")


@query
def catalog_members(t):
    return _members(t).select("track_id", "genre_top")


@query
def catalog_diverse_25(t):
    return CT.draw_by_rank(_eligible(t), COUNT, SEED).select(
        "track_id", "genre_top", "artist_id", "is_repeat", F.col("genre_rank").cast("bigint").alias("genre_rank")
    )


@query
def catalog_diverse_exact(t):
    return CT.select_diverse(_members(t), COUNT, SEED).select("track_id", "genre_top", "artist_id", "selection_order")


@query
def content_hash(t):
    digest = F.sha2("text", 256)
    return t.documents.select(
        "doc_id", digest.alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"),
        X.recording_id(F.lit(None).cast("string"), digest).alias("recording_id"),
    )


@query
def recording_ids(t):
    """Given, missing and empty ids."""
    given = F.nullif(F.col("o_orderpriority"), F.lit("2-HIGH"))
    supplied = F.when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(given)
    identity = X.recording_id(supplied, F.sha2(F.col("o_orderkey").cast("string"), 256))
    return t.orders.select("o_orderkey", identity.alias("recording_id"), X.is_safe_id(identity).alias("safe"))


# Rules --------------------------------------------------------------------------------------


@query
def config_violations(t):
    p = t.part
    spectrogram = RL.broken_rules(
        p.select(
            "p_partkey", F.col("p_name").alias("name"), (F.col("p_size") * 64).alias("n_fft"),
            F.col("p_retailprice").cast("bigint").alias("hop_length"),
            (F.lit(1000.0) - F.col("p_retailprice")).alias("minimum_db"),
        ),
        ["p_partkey"], RL.spectrogram_rules(),
    ).withColumn("config", F.lit("spectrogram"))
    canonical = RL.broken_rules(
        p.select(
            "p_partkey", (F.col("p_size") - 10).alias("sample_rate_hz"), F.pmod("p_size", F.lit(4)).alias("channels"),
            F.when(F.col("p_type") == "ECONOMY", "pcm_s16le").otherwise("pcm_s24le").alias("codec"),
            F.lit(3).alias("sample_width_bytes"),
        ),
        ["p_partkey"], RL.canonical_rules(),
    ).withColumn("config", F.lit("canonical"))
    separation = RL.broken_rules(
        p.select(
            "p_partkey", F.split("p_name", " ").alias("words"), F.col("p_type"),
            (F.col("p_size") - 5).cast("double").alias("maximum_error"),
        ).withColumn("required_stems", F.concat("words", F.transform("words", lambda w: F.lower(w)))),
        ["p_partkey"], RL.separation_rules(),
    ).withColumn("config", F.lit("separation"))
    passage = RL.broken_rules(
        p.select(
            "p_partkey", (F.col("p_size") - 20).alias("beats_per_passage"),
            (F.col("p_retailprice") - 950).alias("minimum_seconds"),
        ),
        ["p_partkey"], RL.passage_rules(),
    ).withColumn("config", F.lit("passages"))
    parts = spectrogram.unionByName(canonical).unionByName(separation).unionByName(passage)
    return parts.select("p_partkey", "config", "rule")


@query
def config_digests(t):
    digest = X.config_digest(
        n_fft=(F.col("p_size") * 64), hop_length=F.col("p_size"), name=F.col("p_type"), window=F.lit("hann")
    )
    return t.part.select("p_partkey", digest.alias("config_sha256"))


@query
def geometry_mismatch(t):
    orders = t.orders.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("channels"),
        F.when(F.col("o_orderstatus") == "F", 44_100).otherwise(48_000).alias("sample_rate_hz"),
        F.when(F.col("o_totalprice") > 200_000, 3).otherwise(2).alias("sample_width_bytes"),
        F.lit("NONE").alias("compression_type"),
    )
    want = {
        "channels": F.lit(2), "sample_rate_hz": F.lit(44_100), "sample_width_bytes": F.lit(3),
        "compression_type": F.lit("NONE"),
    }
    return RL.geometry_mismatches(orders, ["o_orderkey"], want, {k: F.col(k) for k in want})


# Timelines ----------------------------------------------------------------------------------


@query
def timeline_sections(t):
    placed = TL.align_intervals(B.sections(t), B.recordings(t), None, "section_index")
    return placed.select(_conv(), F.col("section_index").alias("turn"), "start_seconds", "end_seconds", "start_sample", "end_sample")


def _timeline_problems(t: B.Tables) -> DataFrame:
    """Removing the system turns leaves gaps to be found."""
    spoken = B.sections(t).filter(F.col("label") != "system")
    durations = B.recordings(t).withColumn("hypothesis_id", F.lit("turns"))
    return TL.contiguity_violations(spoken, durations, KEYS, "section_index", "structure")


@query
def timeline_violations(t):
    return _timeline_problems(t).select(_conv(), "check", "subject")


@query
def beat_order_violations(t):
    points = t.events.select(
        F.col("user_id").cast("string").alias("recording_id"), "event_id", F.col("value").alias("seconds")
    )
    durations = points.select("recording_id").distinct().withColumn("duration_seconds", F.lit(100.0))
    found = TL.order_violations(
        points, durations, ["recording_id"], "event_id", "seconds", "beats", F.floor(F.col("event_id") / TL.RUN)
    )
    return found.select(
        F.col("recording_id").cast("bigint").alias("user_id"), F.col("subject").cast("bigint").alias("event_id"), "check"
    )


@query
def interval_pairs(t):
    pairs = TL.intervals_between(B.beats(t), KEYS, "seconds")
    return pairs.select(_conv(), "start_seconds", "end_seconds")


@query
def boundary_set(t):
    shifted = B.beats(t).select("recording_id", (F.col("seconds") - F.lit(5.0)).alias("seconds"))
    return TL.boundary_set(shifted, B.recordings(t), ["recording_id"]).select(_conv(), "seconds")


def _frame_range(t: B.Tables, config: str) -> DataFrame:
    placed = TL.align_intervals(B.sections(t), B.recordings(t), B.axes(t), "section_index")
    frames = F.try_element_at("spectrogram_frames", F.lit(config))
    return placed.select(
        _conv(), F.col("section_index").alias("turn"), frames["start"].alias("start_frame"), frames["end"].alias("end_frame")
    )


@query
def frame_range_transient(t):
    return _frame_range(t, "transient")


@query
def frame_range_harmonic(t):
    return _frame_range(t, "harmonic")


@query
def spectrogram_axes(t):
    return B.axes(t).select(
        _conv(), "config", "frequency_bins", "time_frames", "first_frame_center_seconds", "last_frame_center_seconds"
    )


# Passages -----------------------------------------------------------------------------------


@query
def passages_greedy(t):
    return PS.passage_cuts(B.sections(t), B.beats(t), 2, 4.0).select(
        _conv(), F.col("section_index").alias("turn"), "start_seconds", "end_seconds"
    )


@query
def passage_index(t):
    return PS.passage_cuts(B.sections(t), B.beats(t), 2, 4.0).select(_conv(), "passage_index", "start_seconds")


@query
def passages_aligned(t):
    stems = t.events.filter(F.col("event_type") != "view").select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.create_map(*[x for e, s in B.STEM_OF_EVENT.items() for x in (F.lit(e), F.lit(s))])[F.col("event_type")].alias("stem"),
    ).distinct().select(
        "recording_id", "stem", F.concat_ws("/", "recording_id", "stem").alias("path"),
        F.sha2(F.concat_ws("/", "recording_id", "stem"), 256).alias("sha256"),
    )
    built = PS.build_passages(B.sections(t), B.beats(t), B.recordings(t), B.axes(t), stems, 2, 4.0)
    transient = F.try_element_at("spectrogram_frames", F.lit("transient"))
    return built.select(
        _conv(), "passage_index", "section_index", "section_label", "start_sample", "end_sample",
        transient["start"].alias("start_frame"), transient["end"].alias("end_frame"),
        F.coalesce(F.size("aligned_stems"), F.lit(0)).cast("bigint").alias("stems"),
        F.try_element_at("aligned_stems", F.lit("vocals"))["sha256"].alias("vocals_sha256"),
    )


# Beats --------------------------------------------------------------------------------------


@query
def downbeat_phase(t):
    marked = ST.mark_downbeats(B.user_beats(t), ["user_id"])
    return marked.groupBy("user_id").agg(
        F.max("downbeat_phase").cast("bigint").alias("downbeat_phase"),
        F.count_if("is_downbeat").alias("downbeats"),
    )


@query
def tempo_mode(t):
    found = LN.tempo_from_beats(B.user_beats(t), ["user_id"], "seconds", 24.0)
    return found.select("user_id", F.col("tempo_bpm").cast("bigint").alias("tempo_bpm"))


@query
def onset_at_beats(t):
    """Beats three hours after each event, read from the user's hourly onset axis and kept on it."""
    hour = F.floor((B.event_micros() - F.lit(1_704_067_200_000_000)) / F.lit(3_600_000_000)).cast("bigint")
    user = F.col("user_id").cast("string").alias("recording_id")
    frames = t.events.groupBy(user, hour.alias("frame_index")).agg(F.sum(B.cents()).alias("onset"))
    beats = t.events.select(user, "event_id", (hour + 3).alias("frame_index"))
    found = ST.attach_onsets(beats, frames)
    return found.select(F.col("recording_id").cast("bigint").alias("user_id"), "event_id", "frame_index", "onset")


@query
def count_rules(t):
    """How many spans and groups a recording gets, and its length on the canonical clock."""
    sized = B.recordings(t).select(
        "recording_id",
        F.round(F.col("frame_count") / F.col("sample_rate_hz"), 9).alias("duration_seconds"),
        X.seconds_to_frame("duration_seconds", F.lit(512), "sample_rate_hz").alias("frames"),
    )
    return sized.withColumn("spans", X.section_count("duration_seconds", "frames")).select(
        _conv(), "duration_seconds", "frames", "spans", X.group_count("spans").alias("groups"),
        X.group_letter(X.group_count("spans") - 1).alias("last_label"),
    )


# Separation ---------------------------------------------------------------------------------


def _stem_name() -> F.Column:
    pairs = [x for e, s in B.STEM_OF_EVENT.items() for x in (F.lit(e), F.lit(s))]
    return F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.col("event_type"))


@query
def stem_contract(t):
    daily = t.events.select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("recording_id"), _stem_name().alias("stem")
    )
    found = SP.contract_violations(daily.select("recording_id").distinct(), daily)
    return found.select("recording_id", "check", F.col("subject").alias("stem"))


@query
def stem_alignment(t):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint") + 1
    rows = t.events.select(
        F.col("user_id").cast("string").alias("recording_id"), "event_type", _stem_name().alias("stem"), day.alias("day")
    )
    shape = lambda df, *k: df.groupBy(*k).agg(
        F.max("day").alias("frame_count"), F.lit(B.RATE).alias("sample_rate_hz"), F.lit(1).alias("channels")
    )
    mixtures = shape(rows, "recording_id")
    stems = shape(rows.filter(F.col("event_type") != "view"), "recording_id", "stem")
    return SP.alignment_violations(mixtures, stems).select(
        F.col("recording_id").cast("bigint").alias("user_id"), "check", F.col("subject").alias("stem"), "detail"
    )


def _mix_and_stems(t: B.Tables) -> tuple[DataFrame, DataFrame]:
    blocks = B.event_blocks(t)
    return blocks.filter(F.col("track") == "mixture"), blocks.filter(F.col("track") != "mixture")


@query
def stem_residual(t):
    residual = SP.residual_blocks(*_mix_and_stems(t))
    return residual.select(
        F.col("recording_id").cast("bigint").alias("user_id"), "start_sample", F.posexplode(F.get("residual", F.lit(0))).alias("pos", "x")
    ).select("user_id", (F.col("start_sample") + F.col("pos")).alias("day"), F.col("x").cast("bigint").alias("residual"))


@query
def reconstruction_metrics(t):
    found = SP.reconstruction_metrics(SP.block_energies(*_mix_and_stems(t)))
    r = lambda name: F.round(name, 6).alias(name)
    return found.select(
        F.col("recording_id").cast("bigint").alias("user_id"),
        r("mixture_rms"), r("residual_rms"), r("normalized_reconstruction_error"),
        r("reconstruction_snr_db"), r("maximum_absolute_residual"), r("peak_vocals"), r("peak_drums"), r("peak_bass"), r("peak_other"),
        "within_threshold",
    )


@query
def block_loudness(t):
    found = SP.block_loudness(B.event_blocks(t))
    return found.select(
        F.col("recording_id").cast("bigint").alias("user_id"), "track",
        F.round("reference_mean", 4).alias("reference_mean"), F.round("reference_std", 4).alias("reference_std"),
    )


@query
def loudness_normalise(t):
    stats = SP.loudness(t.events, ["event_type"], "value")
    rows = attach(t.events.select("event_id", "event_type", "value"), stats, ["event_type"], "event_id")
    return rows.select(
        "event_id",
        F.round(SP.normalised("value"), 6).alias("normalised"),
        F.round(SP.denormalised(SP.normalised("value") / F.lit(200.0), "reference_mean", "reference_std") , 6).alias("restored"),
        F.round(X.clamp(SP.normalised("value"), -SP.CLAMP, SP.CLAMP), 6).alias("clamped"),
    )


@query
def pcm_mono(t):
    two = F.array(F.array(F.col("l_partkey").cast("int")), F.array(F.col("l_suppkey").cast("int")))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.get(SP.downmix(SP.pcm_to_float(two, F.lit(16))), F.lit(0)).cast("double").alias("mono"),
    )


# Frames -------------------------------------------------------------------------------------


def _vec() -> F.Column:
    return F.col("recording_id").cast("bigint").alias("vec_id")


@query
def dft_magnitude(t):
    frames = FR.spectrogram_frames(B.vector_blocks(t), [VECTOR], precise=True)
    return frames.select(_vec(), F.posexplode("magnitude_dbfs").alias("bin", "x")).select(
        "vec_id", F.col("bin").cast("bigint").alias("bin"), F.round(F.col("x").cast("double"), 4).alias("dbfs")
    )


@query
def framed_energy(t):
    cut = t.embeddings.select("vec_id", F.posexplode(FR.framed("embedding", 16, 4)).alias("frame", "w"))
    energy = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return cut.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.round(energy, 6).alias("energy"))


@query
def spectrogram_summary(t):
    frames = FR.spectrogram_frames(B.vector_blocks(t), [SHORT], precise=True)
    return FR.spectrogram_summary(frames).select(
        _vec(), "time_frames", F.col("frequency_bins").cast("bigint").alias("frequency_bins"),
        "first_frame_center_seconds", "last_frame_center_seconds",
    )


@query
def filterbank_bands(t):
    linear = FR.spectrogram_frames(B.vector_blocks(t, BAND_RATE), [VECTOR], decibels=False, precise=True)
    bank = S.log_filterbank(BAND_FRAME, BAND_RATE, BAND_LOW, BAND_HIGH)
    bands = FR.project_frames(linear.select("recording_id", "magnitude_dbfs"), "magnitude_dbfs", bank, "bands")
    return bands.select(_vec(), F.posexplode("bands").alias("band", "x")).select(
        "vec_id", F.col("band").cast("bigint").alias("band"),
        F.round(X.log_compress(F.col("x").cast("double")), 5).alias("energy"),
    )


def _stem_bands(t: B.Tables) -> DataFrame:
    stems = F.array(*[F.lit(s) for s in FR.STEM_ORDER])
    blocks = B.vector_blocks(
        t, BAND_RATE, F.floor(F.col("vec_id") / 4), F.get(stems, F.pmod("vec_id", F.lit(4)).cast("int"))
    )
    return FR.log_band_frames(blocks, BAND_FRAME, BAND_HOP, BAND_RATE, BAND_LOW, BAND_HIGH, precise=True)


@query
def log_band_features(t):
    return _stem_bands(t).select(
        F.col("recording_id").cast("bigint").alias("song"), "track", "frame_index", F.posexplode("bands").alias("band", "x")
    ).select("song", "track", "frame_index", F.col("band").cast("bigint").alias("band"),
             F.round(F.col("x").cast("double"), 5).alias("energy"))


@query
def stacked_features(t):
    stacked = FR.stack_stems(_stem_bands(t))
    first = lambda i: F.round(F.get(F.get("stems", F.lit(i)), F.lit(5)).cast("double"), 5)
    return stacked.select(
        F.col("recording_id").cast("bigint").alias("song"), "frame_index",
        *[first(i).alias(s) for i, s in enumerate(FR.STEM_ORDER)],
    )


@query
def feature_shapes(t):
    return FR.feature_shapes(_stem_bands(t)).select(
        F.col("recording_id").cast("bigint").alias("song"), "stems", "frames",
        F.col("bands").cast("bigint").alias("bands"), "shapes",
    )


@query
def onset_flux(t):
    frames = B.label_frames(t).select(
        "recording_id", F.lit("mixture").alias("track"), F.lit("vector").alias("config"),
        F.col("vec_id").alias("frame_index"), F.col("embedding").alias("magnitude_dbfs"),
    )
    return FR.onset_from_frames(frames).select(
        F.col("recording_id").cast("bigint").alias("label"), F.col("frame_index").alias("vec_id"),
        F.round("onset", 6).alias("onset"),
    )


@query
def chroma_fold(t):
    linear = FR.spectrogram_frames(B.vector_blocks(t), [VECTOR], decibels=False, precise=True)
    folded = FR.project_frames(
        linear.select("recording_id", "magnitude_dbfs"), "magnitude_dbfs", S.chroma_map(64, B.RATE), "chroma"
    )
    peak = F.array_max("chroma").cast("double")
    return folded.select(_vec(), peak.alias("peak"), F.posexplode("chroma").alias("pitch_class", "x")).select(
        "vec_id", F.col("pitch_class").cast("bigint").alias("pitch_class"),
        F.round(F.try_divide(F.col("x").cast("double"), F.col("peak")), 5).alias("strength"),
    )


# Learned sections ---------------------------------------------------------------------------


@query
def activation_probs(t):
    logits = t.embeddings.select(
        F.col("vec_id").cast("string").alias("recording_id"), F.lit("m").alias("model"),
        F.lit(0).cast("bigint").alias("frame"),
        *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(("beat_logit", "downbeat_logit", "boundary_logit"))],
        F.col("embedding").alias("label_logits"),
    )
    found = LN.activation_probabilities(logits)
    return found.select(
        _vec(), F.round("beat_probability", 6).alias("beat_probability"), F.posexplode("label_probability").alias("pos", "p")
    ).select("vec_id", "beat_probability", F.col("pos").cast("bigint").alias("pos"), F.round("p", 6).alias("probability"))


@query
def section_distribution(t):
    frames = B.label_frames(t)
    cuts = frames.groupBy("recording_id", F.floor(F.col("frame") / 16).alias("section_index")).agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")
    )
    means = LN.section_distributions(frames, cuts, ["recording_id"], "embedding", 64)
    return means.select(
        F.col("recording_id").cast("bigint").alias("label"), "section_index", F.posexplode("distribution").alias("pos", "x")
    ).select("label", "section_index", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("mean"))


@query
def label_top3(t):
    probabilities = X.softmax("embedding")
    names = tuple(f"label_{i:02d}" for i in range(64))
    top = t.embeddings.select("vec_id", F.posexplode(LN.top_labels(probabilities, names)).alias("rank", "top"))
    return top.select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("top.label").alias("label"),
        F.round("top.probability", 6).alias("probability"),
    )


def _segments(frames: DataFrame) -> DataFrame:
    """Seven-frame segments of the label recordings, between a start and an end marker."""
    cuts = frames.groupBy("recording_id", F.floor(F.col("frame") / 7).alias("segment_index")).agg(
        F.min("frame").alias("first"), (F.max("frame") + 1).alias("stop")
    )
    last = cuts.groupBy("recording_id").agg(F.max("segment_index").alias("last"))
    names = F.array(*[F.lit(n) for n in ("inst", "verse", "chorus", "unheard")])
    label = (
        F.when(F.col("segment_index") == 0, "start")
        .when(F.col("segment_index") == F.col("last"), "end")
        .otherwise(F.get(names, F.pmod("segment_index", F.lit(4)).cast("int")))
    )
    return attach(cuts, last, ["recording_id"], "segment_index").select(
        "recording_id", F.lit("m").alias("model"), "segment_index",
        (F.col("first") / F.lit(100.0)).alias("start"), (F.col("stop") / F.lit(100.0)).alias("end"), label.alias("label"),
    )


@query
def learned_sections(t):
    frames = cut_lineage(B.label_frames(t))
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: (x * 10).cast("float"))
    activations = frames.select(
        "recording_id", F.lit("m").alias("model"), "frame",
        *[F.get("embedding", F.lit(10 + i)).alias(n) for i, n in enumerate(("beat_logit", "downbeat_logit", "boundary_logit"))],
        logits.alias("label_logits"),
    )
    recordings = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).select(
        "recording_id", (F.col("n") / F.lit(100.0)).alias("duration_seconds"), F.lit(B.RATE).alias("sample_rate_hz"),
        (F.col("n") * 441).alias("frame_count"),
    )
    found = LN.learned_sections(activations, _segments(frames), recordings)
    top = lambda i: F.get("label_hypotheses", F.lit(i))
    return found.select(
        F.col("recording_id").cast("bigint").alias("song"), "section_index", "start_seconds", "end_seconds",
        "start_sample", "end_sample", "label", F.round("confidence", 6).alias("confidence"),
        F.round("boundary_confidence", 6).alias("boundary_confidence"),
        top(0)["label"].alias("first_label"), top(2)["label"].alias("third_label"),
        F.round(top(1)["probability"], 6).alias("second_probability"),
    )


@query
def marker_fold(t):
    cut = B.sections(t)
    size = cut.groupBy("recording_id").agg(F.max("section_index").alias("last"))
    label = (
        F.when(F.col("section_index") == 0, "start")
        .when(F.col("section_index") == F.col("last"), "end")
        .when(F.col("label") == "assistant", "inst")
        .otherwise(F.col("label"))
    )
    segments = attach(cut, size, ["recording_id"], "section_index").select(
        "recording_id", F.lit("m").alias("model"), F.col("section_index").alias("segment_index"),
        F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), label.alias("label"),
    )
    return LN.fold_markers(segments, B.recordings(t)).select(_conv(), "section_index", "start", "end", "label")


# Corrections, lineage, validation -----------------------------------------------------------


def _bases(t: B.Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").cast("string").alias("recording_id"), F.lit("baseline").alias("hypothesis_id"),
        F.sha2("text", 256).alias("sha256"), (F.col("n_chars") / F.lit(10.0)).alias("duration_seconds"),
        F.lit("unsupervised-baseline").alias("backend"),
    )


def _corrections(t: B.Tables) -> DataFrame:
    """A two-part correction per label: toxic ones name a wrong base, low quality is over-confident."""
    half = F.floor(F.col("n_chars") / 2) / F.lit(10.0)
    joined = t.labels.join(t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("sha")), "doc_id")
    part = lambda start, end, label, confidence: F.struct(
        start.alias("start_seconds"), end.alias("end_seconds"), F.lit(label).alias("label"),
        confidence.cast("double").alias("confidence"), F.lit(None).cast("string").alias("notes"),
    )
    none = F.lit(None)
    return joined.select(
        F.concat(F.lit("c"), "doc_id").alias("correction_id"), F.col("doc_id").cast("string").alias("recording_id"),
        F.lit("structure-correction/v1").alias("schema"),
        F.when(F.col("toxic") == 1, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.col("sha")).alias("base_manifest_sha256"),
        F.lit("reviewer").alias("annotator"), F.lit("2031-03-04T05:06:07+01:00").alias("created_at"),
        F.array(
            part(F.lit(0.0), half, "intro", none),
            part(half, F.col("n_chars") / F.lit(10.0), "verse", F.when(F.col("quality") == 0, 1.5).otherwise(0.5)),
        ).alias("sections"),
    )


@query
def apply_corrections(t):
    recordings = _bases(t).select(
        "recording_id", F.lit(B.RATE).alias("sample_rate_hz"),
        X.half_even(F.col("duration_seconds") * B.RATE).alias("frame_count"),
    )
    beats = _bases(t).select(
        "recording_id", "hypothesis_id", F.lit(0).cast("bigint").alias("beat_index"), F.lit(0.0).alias("seconds")
    )
    done = CR.apply_corrections(_corrections(t), _bases(t), beats, recordings)
    return done.sections.select(
        F.col("recording_id").cast("bigint").alias("doc_id"), "hypothesis_id", "section_index", "start_seconds",
        "end_seconds", "label", "label_kind", "confidence", "start_sample", "end_sample",
    )


@query
def corrected_structures(t):
    """The new hypotheses' own rows: kept scalars, lineage, and the base's beats under the new key."""
    recordings = _bases(t).select("recording_id", F.lit(B.RATE).alias("sample_rate_hz"), F.lit(0).cast("bigint").alias("frame_count"))
    beats = _bases(t).select(
        "recording_id", "hypothesis_id", F.lit(0).cast("bigint").alias("beat_index"), F.col("duration_seconds").alias("seconds")
    )
    done = CR.apply_corrections(_corrections(t), _bases(t), beats, recordings)
    moved = done.beats.select("recording_id", "hypothesis_id", "beat_index", "seconds")
    return done.structures.join(moved, ["recording_id", "hypothesis_id"]).select(
        F.col("recording_id").cast("bigint").alias("doc_id"), "hypothesis_id", "backend", "base_backend",
        "base_hypothesis_id", "base_manifest_sha256", "annotator", "duration_seconds", "beat_index",
        F.col("seconds").alias("beat_seconds"),
    )


@query
def correction_problems(t):
    found = CR.correction_violations(CR.judge_corrections(_corrections(t), _bases(t)))
    return found.select(F.col("recording_id").cast("bigint").alias("doc_id"), "check", F.col("subject").alias("correction_id"))


def _lineage_problems(t: B.Tables) -> DataFrame:
    parents = t.documents.select(
        F.col("doc_id").cast("string").alias("recording_id"), F.lit("wave:mixture").alias("parent_kind"),
        F.sha2("text", 256).alias("sha256"),
    )
    claims = t.labels.join(t.documents.select("doc_id", "text", "lang"), "doc_id").select(
        F.col("doc_id").cast("string").alias("recording_id"), F.lit("structure").alias("stage"), F.lit("label").alias("child"),
        F.lit("wave:mixture").alias("parent_kind"),
        F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.col("lang")), 256).alias("claimed_sha256"),
    )
    orphans = t.benchmark.select(
        F.concat(F.lit("b"), "item_id").alias("recording_id"), F.lit("structure").alias("stage"), F.lit("item").alias("child"),
        F.lit("wave:mixture").alias("parent_kind"), F.sha2("text", 256).alias("claimed_sha256"),
    )
    return lineage_violations(claims.unionByName(orphans), parents)


@query
def lineage_problems(t):
    return _lineage_problems(t).select("recording_id", "check", "subject")


@query
def validation_report(t):
    shared = ["recording_id", "stage", "check", "subject", "severity", "detail"]
    timeline = _timeline_problems(t)
    contract = SP.contract_violations(
        B.recordings(t), t.events.select(F.col("user_id").cast("string").alias("recording_id"), _stem_name().alias("stem"))
    ).withColumn("severity", F.lit("warn"))
    found = timeline.select(*shared).unionByName(contract.select(*shared))
    report = roll_up(B.recordings(t), found, {"section_count": B.sections(t), "beat_count": B.beats(t)})
    return report.select(
        _conv(), "valid", "errors", "warnings", F.size("failed_checks").cast("bigint").alias("failed_checks"),
        "section_count", "beat_count",
    )


# Unsupervised structure ---------------------------------------------------------------------


def _spans(labelled: DataFrame) -> DataFrame:
    frames = labelled.select("recording_id", F.col("frame").alias("frame_index"), "embedding")
    spans = frames.select("recording_id").distinct().withColumn("span_count", F.lit(8).cast("bigint"))
    return cut_lineage(ST.segment_frames(frames, "embedding", 64, spans))


@query
def ward_segments(t):
    return _spans(B.label_frames(t)).select(F.col("recording_id").cast("bigint").alias("song"), "frame_index")


@query
def section_groups(t):
    frames = cut_lineage(B.label_frames(t))
    sizes = frames.groupBy("recording_id").agg(F.count(F.lit(1)).alias("end"))
    edges = _spans(frames).select("recording_id", F.col("frame_index").cast("double").alias("seconds")).unionByName(
        sizes.select("recording_id", F.col("end").cast("double").alias("seconds"))
    )
    # Eight spans per recording, so the numbering sees eight rows of each.
    spans = with_position(
        TL.intervals_between(edges, ["recording_id"], "seconds"), ["recording_id"], "start_seconds", F.lit(0), "section_index"
    ).select(
        "recording_id", "section_index", F.col("start_seconds").cast("bigint").alias("start_frame"),
        F.col("end_seconds").cast("bigint").alias("end_frame"),
    )
    means = LN.section_distributions(frames, spans, ["recording_id"], "embedding", 64)
    return ST.group_sections(means).select(F.col("recording_id").cast("bigint").alias("song"), "section_index", "label")


@query
def beat_track(t):
    """Hourly event value of each user as an onset envelope."""
    hour = F.floor((B.event_micros() - F.lit(1_704_067_200_000_000)) / F.lit(3_600_000_000)).cast("bigint")
    heard = t.events.groupBy(F.col("user_id").cast("string").alias("recording_id"), hour.alias("frame_index")).agg(
        F.sum("value").alias("onset")
    )
    span = heard.groupBy("recording_id").agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b"))
    grid = span.select("recording_id", F.explode(F.sequence("a", "b")).alias("frame_index"))
    frames = grid.join(heard, ["recording_id", "frame_index"], "left").withColumn("onset", F.coalesce("onset", F.lit(0.0)))
    tempo = ST.estimate_tempo(frames, 24.0)
    beats = ST.track_beats(frames, tempo, 24.0)
    return beats.select(F.col("recording_id").cast("bigint").alias("user_id"), "beat_index", "frame_index")
