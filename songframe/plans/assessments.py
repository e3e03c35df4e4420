"""Queries on quality, hypotheses and retrieval, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.operators import defects as DF
from songframe.operators import drift as DR
from songframe.operators import evaluation as EV
from songframe.operators import frames as FR
from songframe.operators import retrieval as RT
from songframe.operators import sketches as SK
from songframe.operators import timeline as TL
from songframe.operators.validation import CatalogTables, validate_catalog
from songframe.plans import testbed as B
from songframe.plans.oracles import _BEATS, _FILTERS, _SECTIONS
from songframe.plans.queries import BAND_FRAME, BAND_HIGH, BAND_HOP, BAND_LOW, BAND_RATE, query
from songframe.session import checkpoint_root
from songframe.sources.ordered_store import save_ordered

SPAN_SECONDS = 37.5
LOUD_CENTS = 5_000.0
ORACLES: dict[str, str] = {}


def _conv() -> F.Column:
    return F.col("recording_id").cast("bigint").alias("conv_id")


def _turns(t: B.Tables) -> DataFrame:
    return B.sections(t).select("recording_id", "start_seconds", "end_seconds", "label")


def _spans(t: B.Tables) -> DataFrame:
    """Spans of equal length, labelled in turn."""
    last = F.floor(F.col("duration_seconds") / SPAN_SECONDS)
    spans = B.recordings(t).select("recording_id", "duration_seconds", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    return spans.select(
        "recording_id", (F.col("k") * SPAN_SECONDS).alias("start_seconds"),
        F.least((F.col("k") + 1) * SPAN_SECONDS, F.col("duration_seconds")).alias("end_seconds"),
        F.substring(F.lit("abc"), (F.col("k") % 3 + 1).cast("int"), F.lit(1)).alias("label"),
    )


def _beat_spans(t: B.Tables) -> DataFrame:
    """From each beat to the next, labelled by the beat's second."""
    beats = B.beats(t).select("recording_id", "seconds")
    between = TL.intervals_between(beats, ["recording_id"], "seconds")
    odd = F.floor(F.col("start_seconds")) % 2 == 1
    return between.withColumn("label", F.when(odd, "odd").otherwise("even"))


def _three(t: B.Tables) -> DataFrame:
    kinds = {"turns": _turns(t), "spans": _spans(t), "beats": _beat_spans(t)}
    tables = [df.withColumn("hypothesis_id", F.lit(name)) for name, df in kinds.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


_SPANS = f"""
spans AS (
  SELECT conv_id, k * {SPAN_SECONDS} AS start_s, least((k + 1) * {SPAN_SECONDS}, duration) AS end_s, substr('abc', CAST(k % 3 + 1 AS BIGINT), 1) AS label
  FROM (SELECT conv_id, duration, unnest(range(CAST(floor(duration / {SPAN_SECONDS}) AS BIGINT) + 1)) AS k FROM recordings))"""

_HYPOTHESES = f"""{_SECTIONS}, {_BEATS}, {_SPANS},
beat_spans AS (SELECT conv_id, lag(s) OVER (PARTITION BY conv_id ORDER BY s) AS start_s, s AS end_s FROM beats),
hypotheses AS (
  SELECT conv_id, 'turns' AS hypothesis_id, start_s, end_s, role AS label FROM sections
  UNION ALL SELECT conv_id, 'spans', start_s, end_s, label FROM spans
  UNION ALL SELECT conv_id, 'beats', start_s, end_s, CASE WHEN CAST(floor(start_s) AS BIGINT) % 2 = 1 THEN 'odd' ELSE 'even' END
    FROM beat_spans WHERE start_s IS NOT NULL),
real AS (SELECT * FROM hypotheses WHERE end_s > start_s)"""

_PIECES = """
edges AS (SELECT conv_id, start_s AS s FROM real UNION SELECT conv_id, end_s FROM real),
pieces AS (SELECT conv_id, s AS a, lead(s) OVER (PARTITION BY conv_id ORDER BY s) AS b FROM edges),
covered AS (
  SELECT p.conv_id, p.a, p.b, r.hypothesis_id, arg_max(r.label, {'s': r.start_s, 'l': r.label}) AS label
  FROM pieces p JOIN real r ON r.conv_id = p.conv_id AND p.a >= r.start_s AND p.a < r.end_s WHERE p.b IS NOT NULL GROUP BY ALL)"""


@query
def boundary_quality(t):
    turns = _turns(t)
    edges = turns.select("recording_id", F.col("start_seconds").alias("seconds")).union(turns.select("recording_id", "end_seconds")).distinct()
    out = EV.boundary_quality(edges, B.beats(t).select("recording_id", "seconds"), ["recording_id"])
    return out.select(_conv(), "tolerance", "estimated", "reference", "matched", "precision", "recall", "f_measure")


ORACLES["boundary_quality"] = f"""WITH RECURSIVE {_SECTIONS}, {_BEATS},
edges AS (SELECT conv_id, start_s AS s FROM sections UNION SELECT conv_id, end_s FROM sections),
est AS (SELECT conv_id, list(s ORDER BY s) AS e FROM edges GROUP BY conv_id),
ref AS (SELECT conv_id, list(s ORDER BY s) AS r FROM beats GROUP BY conv_id),
both_sides AS (
  SELECT conv_id, tolerance, coalesce(e, []) AS e, coalesce(r, []) AS r
  FROM est FULL JOIN ref USING (conv_id), (SELECT unnest([0.5::DOUBLE, 3.0::DOUBLE]) AS tolerance)),
walk AS (
  SELECT conv_id, tolerance, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS m FROM both_sides
  UNION ALL
  SELECT w.conv_id, w.tolerance,
    CASE WHEN r[j] < e[i] - w.tolerance THEN i ELSE i + 1 END, CASE WHEN e[i] < r[j] - w.tolerance THEN j ELSE j + 1 END,
    CASE WHEN r[j] < e[i] - w.tolerance OR e[i] < r[j] - w.tolerance THEN m ELSE m + 1 END
  FROM walk w JOIN both_sides b ON b.conv_id = w.conv_id AND b.tolerance = w.tolerance WHERE i <= len(e) AND j <= len(r)),
matched AS (SELECT conv_id, tolerance, max(m) AS m FROM walk GROUP BY ALL)
SELECT conv_id, tolerance, len(e) AS estimated, len(r) AS reference, m AS matched,
  CASE WHEN len(e) > 0 THEN m / len(e) END AS precision, CASE WHEN len(r) > 0 THEN m / len(r) END AS recall,
  2 * m / (len(e) + len(r)) AS f_measure
FROM both_sides JOIN matched USING (conv_id, tolerance)"""


@query
def label_confusion(t):
    out = EV.label_confusion(_turns(t), _spans(t), ["recording_id"])
    return out.select(_conv(), "estimated_label", "reference_label", F.rint(F.col("seconds") * 1000).cast("bigint").alias("milliseconds"))


ORACLES["label_confusion"] = f"""WITH {_HYPOTHESES.replace("WHERE end_s > start_s", "WHERE end_s > start_s AND hypothesis_id <> 'beats'")}, {_PIECES},
sides AS (
  SELECT conv_id, a, b, max(label) FILTER (hypothesis_id = 'turns') AS estimated_label, max(label) FILTER (hypothesis_id = 'spans') AS reference_label
  FROM covered GROUP BY ALL)
SELECT conv_id, estimated_label, reference_label, CAST(round(sum(b - a) * 1000) AS BIGINT) AS milliseconds FROM sides GROUP BY ALL"""


@query
def hypotheses_overlay(t):
    pieces = EV.overlay(_three(t), ["recording_id"])
    return pieces.select(_conv(), "start_seconds", "end_seconds", "hypothesis_id", "label")


ORACLES["hypotheses_overlay"] = f"""WITH {_HYPOTHESES}, {_PIECES}
SELECT conv_id, a AS start_seconds, b AS end_seconds, hypothesis_id, label FROM covered"""


@query
def hypotheses_agreement(t):
    """Turn roles stand in for three opinions: each hypothesis' label is cut to its first letter."""
    three = _three(t).withColumn("label", F.substring("label", 1, 1))
    out = EV.agreement(EV.overlay(three, ["recording_id"]), ["recording_id"])
    return out.select(_conv(), "start_seconds", "end_seconds", "hypotheses", "label", "agreeing")


ORACLES["hypotheses_agreement"] = f"""WITH {_HYPOTHESES}, {_PIECES},
votes AS (SELECT conv_id, a, b, substr(label, 1, 1) AS label, count(*) AS n FROM covered GROUP BY ALL)
SELECT conv_id, a AS start_seconds, b AS end_seconds, CAST(sum(n) AS BIGINT) AS hypotheses,
  arg_min(label, {{'n': -n, 'l': label}}) AS label, max(n) AS agreeing FROM votes GROUP BY ALL"""


@query
def recording_defects(t):
    """Daily cents of a user as samples: days without any are silent, rich ones clipped."""
    out = DF.recording_defects(B.event_blocks(t), 0.0, LOUD_CENTS)
    return out.select(F.col("recording_id").cast("bigint").alias("user_id"), "track", "samples", "gaps", "silent_samples", "silent_run", "clipped_samples", "clipped_run")


_GRID = f"""placed AS (
  SELECT user_id, (epoch_us(ts) - 1704067200000000) // 86400000000 AS day, event_type, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events),
tracks AS (SELECT unnest(['mixture', 'vocals', 'drums', 'bass', 'other']) AS track, unnest([NULL, 'purchase', 'click', 'signup', 'error']) AS kind),
blocks AS (SELECT DISTINCT user_id, CAST(floor(day / {B.BLOCK_DAYS}) AS BIGINT) AS block FROM placed),
grid AS (SELECT user_id, block, block * {B.BLOCK_DAYS} + unnest(range({B.BLOCK_DAYS})) AS day FROM blocks),
valued AS (
  SELECT g.user_id, track, g.block, g.day, CAST(coalesce(sum(cents) FILTER (kind IS NULL OR event_type = kind), 0) AS FLOAT) AS x
  FROM grid g CROSS JOIN tracks LEFT JOIN placed p ON p.user_id = g.user_id AND p.day = g.day GROUP BY ALL)"""

ORACLES["recording_defects"] = f"""WITH {_GRID},
flagged AS (SELECT *, abs(x) <= 0 AS silent, abs(x) >= {LOUD_CENTS} AS clipped FROM valued),
silences AS (SELECT user_id, track, max(n) AS silent_run FROM (
  SELECT user_id, track, count(*) AS n FROM (
    SELECT *, day - row_number() OVER (PARTITION BY user_id, track ORDER BY day) AS island FROM flagged WHERE silent) GROUP BY user_id, track, island) GROUP BY ALL),
clips AS (SELECT user_id, track, max(n) AS clipped_run FROM (
  SELECT user_id, track, count(*) AS n FROM (
    SELECT *, day - row_number() OVER (PARTITION BY user_id, track ORDER BY day) AS island FROM flagged WHERE clipped) GROUP BY user_id, track, island) GROUP BY ALL),
gaps AS (SELECT user_id, count(*) FILTER (block > coalesce(before, -1) + 1) AS gaps FROM (
  SELECT user_id, block, lag(block) OVER (PARTITION BY user_id ORDER BY block) AS before FROM blocks) GROUP BY ALL)
SELECT user_id, track, count(*) AS samples, gaps, count(*) FILTER (silent) AS silent_samples, coalesce(silent_run, 0) AS silent_run,
  count(*) FILTER (clipped) AS clipped_samples, coalesce(clipped_run, 0) AS clipped_run
FROM flagged LEFT JOIN silences USING (user_id, track) LEFT JOIN clips USING (user_id, track) JOIN gaps USING (user_id) GROUP BY ALL"""


@query
def interval_retrieval(t):
    """The five days from each signup on, from all five tracks of the user, out of a table stored in order."""
    spark = t.spark
    path = f"{checkpoint_root(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = save_ordered(B.event_blocks(t).withColumn("length", RT.stored_length()), path, files)
    day = F.floor((B.event_micros() - F.lit(1_704_067_200_000_000)) / F.lit(86_400_000_000)).cast("bigint")
    requests = t.events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("interval_id"), F.col("user_id").cast("string").alias("recording_id"), day.alias("start_sample"), (day + 5).alias("end_sample")
    )
    cents = F.aggregate(F.get("samples", F.lit(0)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return RT.samples_in(table, requests).groupBy("interval_id", "track").agg(
        F.min("start_sample").alias("first_day"), F.sum(F.size(F.get("samples", F.lit(0)))).alias("days"), F.sum(cents).alias("cents")
    )


ORACLES["interval_retrieval"] = f"""WITH {_GRID},
asked AS (SELECT event_id AS interval_id, user_id, (epoch_us(ts) - 1704067200000000) // 86400000000 AS first FROM events WHERE event_type = 'signup')
SELECT interval_id, track, min(day) AS first_day, count(*) AS days, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS cents
FROM asked JOIN valued USING (user_id) WHERE day >= first AND day < first + 5 GROUP BY ALL"""


@query
def interval_hierarchy(t):
    """Frames, beats and sections in spans of equal length of every recording."""
    spans = _spans(t).filter("end_seconds > start_seconds").withColumn("interval_id", F.concat_ws(":", "recording_id", "start_seconds"))
    turns = B.sections(t).filter("end_seconds > start_seconds").select("recording_id", "section_index", "start_seconds", "end_seconds", "label")
    out = RT.retrieve(spans, B.recordings(t), meta=B.axes(t), beats=B.beats(t), sections=turns)
    beats = out.beats.groupBy("interval_id").agg(F.count(F.lit(1)).alias("beats"))
    met = out.sections.groupBy("interval_id").agg(F.min("section_index").alias("first_section"), F.count(F.lit(1)).alias("sections"))
    frames = F.col("spectrogram_frames")["transient"]
    return out.frames.join(beats, "interval_id", "left").join(met, "interval_id", "left").select(
        _conv(), "start_seconds", "start_sample", "end_sample", frames["start"].alias("start_frame"), frames["end"].alias("end_frame"),
        F.coalesce("beats", F.lit(0).cast("bigint")).alias("beats"), "first_section", "sections",
    )


ORACLES["interval_hierarchy"] = f"""WITH {_SECTIONS}, {_BEATS}, {_SPANS},
axes AS (SELECT conv_id, CASE WHEN frame_count < 1024 THEN 0 ELSE (frame_count - 1024) // 256 + 1 END AS frames FROM recordings),
asked AS (SELECT * FROM spans WHERE end_s > start_s),
inside AS (SELECT a.conv_id, a.start_s, count(*) AS beats FROM asked a JOIN beats b ON b.conv_id = a.conv_id AND b.s >= a.start_s AND b.s < a.end_s GROUP BY ALL),
met AS (
  SELECT a.conv_id, a.start_s, min(turn) AS first_section, count(*) AS sections
  FROM asked a JOIN sections c ON c.conv_id = a.conv_id AND c.end_s > c.start_s AND c.start_s < a.end_s AND c.end_s > a.start_s GROUP BY ALL),
placed AS (
  SELECT a.*, CAST(round_even(start_s * 44100, 0) AS BIGINT) AS start_sample, least(CAST(round_even(end_s * 44100, 0) AS BIGINT), frame_count) AS end_sample, frames
  FROM asked a JOIN recordings USING (conv_id) JOIN axes USING (conv_id)),
edges AS (SELECT conv_id, start_s AS s, frames FROM placed UNION SELECT conv_id, end_s, frames FROM placed),
counted AS (
  SELECT conv_id, s, (SELECT count(*) FROM (SELECT unnest(range(frames)) AS i) WHERE CAST(512 + i * 256 AS DOUBLE) / 44100 < s) AS frame FROM edges)
SELECT p.conv_id, p.start_s AS start_seconds, start_sample, end_sample, f.frame AS start_frame, g.frame AS end_frame, coalesce(beats, 0) AS beats, first_section, sections
FROM placed p JOIN counted f ON f.conv_id = p.conv_id AND f.s = p.start_s JOIN counted g ON g.conv_id = p.conv_id AND g.s = p.end_s
LEFT JOIN inside i ON i.conv_id = p.conv_id AND i.start_s = p.start_s LEFT JOIN met m ON m.conv_id = p.conv_id AND m.start_s = p.start_s"""


def _edge_blocks(t: B.Tables, rate: int = B.RATE) -> DataFrame:
    """Four embeddings in a row as one waveform in blocks of 48 samples, which frames reach over."""
    whole = t.embeddings.select(
        F.floor(F.col("vec_id") / 4).cast("string").alias("recording_id"), F.lit("mixture").alias("track"),
        F.pmod("vec_id", F.lit(4)).alias("block_index"), (F.pmod("vec_id", F.lit(4)) * 64).alias("start_sample"),
        F.lit(rate).alias("sample_rate_hz"), F.array("embedding").alias("samples"),
    )
    return FR.with_context(FR.reblocked(whole, 48), 48, 48, 48)


_EDGE_SAMPLES = """
signal AS (
  SELECT vec_id // 4 AS song, (vec_id % 4) * 64 + generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
lengths AS (SELECT song, count(*) AS size FROM signal GROUP BY song)"""


@query
def edge_spectrum(t):
    frames = FR.spectrogram_frames(_edge_blocks(t), [FR.SpectrogramConfig("edge", 32, 8)], precise=True)
    return frames.select(
        F.col("recording_id").cast("bigint").alias("song"), "frame_index", F.posexplode("magnitude_dbfs").alias("bin", "x")
    ).select("song", "frame_index", F.col("bin").cast("bigint").alias("bin"), F.round(F.col("x").cast("double"), 4).alias("dbfs"))


ORACLES["edge_spectrum"] = f"""WITH {_EDGE_SAMPLES},
starts AS (SELECT song, unnest(range((size - 32) // 8 + 1)) AS f FROM lengths),
cut AS (SELECT s.song, f, n - f * 8 AS n, x FROM starts s JOIN signal g ON g.song = s.song AND n >= f * 8 AND n < f * 8 + 32),
spectrum AS (
  SELECT song, f, k,
    sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 32)) * cos(2 * pi() * ((k * n) % 32) / 32)), 2)
       + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 32)) * sin(2 * pi() * ((k * n) % 32) / 32)), 2)) / 16 AS m
  FROM cut, (SELECT unnest(range(17)) AS k) GROUP BY song, f, k)
SELECT song, f AS frame_index, k AS bin, round(CAST(CAST(greatest(20 * log10(greatest(m, 1e-6)), -120) AS FLOAT) AS DOUBLE), 4) AS dbfs FROM spectrum"""


@query
def edge_log_bands(t):
    bands = FR.log_band_frames(_edge_blocks(t, BAND_RATE), BAND_FRAME, BAND_HOP, BAND_RATE, BAND_LOW, BAND_HIGH, precise=True)
    return bands.select(
        F.col("recording_id").cast("bigint").alias("song"), "frame_index", F.posexplode("bands").alias("band", "x")
    ).select("song", "frame_index", F.col("band").cast("bigint").alias("band"), F.round(F.col("x").cast("double"), 5).alias("energy"))


ORACLES["edge_log_bands"] = f"""WITH {_EDGE_SAMPLES},
starts AS (SELECT song, unnest(range((size + 15) // 16)) AS f FROM lengths),
cut AS (SELECT s.song, f, n - (f * 16 - 32) AS n, x FROM starts s JOIN signal g ON g.song = s.song AND n >= f * 16 - 32 AND n < f * 16 + 32),
spectrum AS (
  SELECT song, f, k,
    sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * ((k * n) % 64) / 64)), 2)
       + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * ((k * n) % 64) / 64)), 2)) AS m
  FROM cut, (SELECT unnest(range(32)) AS k) GROUP BY song, f, k),
{_FILTERS}
SELECT song, f AS frame_index, band, round(CAST(CAST(log10(1 + sum(m * w)) AS FLOAT) AS DOUBLE), 5) AS energy
FROM spectrum JOIN filters USING (k) GROUP BY song, f, band"""


@query
def catalog_validation(t):
    """The whole report: lineage, stored axes, missing artifacts and lost sides of learned hypotheses."""
    recordings = B.recordings(t).withColumn("sha256", F.sha2("recording_id", 256))
    number = F.col("recording_id").cast("bigint")
    heard = t.events.select(F.col("user_id").cast("string").alias("recording_id"), "event_id", B.event_micros().alias("us")).join(
        recordings.select("recording_id", F.rint(F.col("duration_seconds") * 1000).cast("bigint").alias("ms")), "recording_id"
    ).filter("ms > 0")
    axes = heard.select(
        "recording_id", F.lit("mixture").alias("track"), F.lit("events").alias("config"), F.col("event_id").alias("frame_index"),
        (F.pmod(F.floor(F.col("us") / 1000).cast("bigint"), F.col("ms")) / F.lit(1000.0) + 0.5).alias("center_seconds"),
    )
    # odd recordings claim another parent
    parent = F.when(number % 2 == 0, F.sha2("recording_id", 256)).otherwise(F.sha2(F.lit("other"), 256))
    separations = heard.select("recording_id").distinct().withColumn("parent_sha256", parent)
    structures = recordings.filter((F.col("frame_count") / 4_410).cast("bigint") % 3 != 0).select(
        "recording_id", F.lit("turns").alias("hypothesis_id"), F.sha2(F.lit("s"), 256).alias("sha256"), F.col("sha256").alias("parent_sha256")
    )
    turns = t.conversations.select(F.col("conv_id").cast("string").alias("recording_id"), F.lit("m").alias("model"), "role", "turn")
    tables = CatalogTables(
        recordings=recordings, spectrogram_axes=axes, separations=separations, structures=structures,
        activations=turns.filter("role = 'system'"), segments=turns.filter("turn = 2"),
    )
    _, report = validate_catalog(tables)
    return report.select(_conv(), "valid", "errors", "warnings", F.array_join("failed_checks", ";").alias("failed_checks"))


ORACLES["catalog_validation"] = f"""WITH {_SECTIONS},
heard AS (
  SELECT conv_id, event_id, CAST((epoch_us(ts) // 1000) % (chars * 100) AS DOUBLE) / 1000 + 0.5 AS s, duration
  FROM events JOIN recordings ON conv_id = user_id WHERE chars > 0),
stepped AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY event_id) AS before FROM heard),
active AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'), cut AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 2),
problems AS (
  SELECT conv_id, 'spectrogram.not_increasing' AS c FROM stepped WHERE s <= before
  UNION ALL SELECT conv_id, 'spectrogram.past_end' FROM stepped WHERE s > duration + 1e-6
  UNION ALL SELECT conv_id, 'separation.lineage_mismatch' FROM heard WHERE conv_id % 2 <> 0 GROUP BY conv_id
  UNION ALL SELECT conv_id, 'separation.missing_artifact' FROM recordings WHERE conv_id NOT IN (SELECT conv_id FROM heard)
  UNION ALL SELECT conv_id, 'structure.missing_artifact' FROM recordings WHERE chars % 3 = 0
  UNION ALL SELECT conv_id, 'learned.missing_segments' FROM active WHERE conv_id NOT IN (SELECT conv_id FROM cut)
  UNION ALL SELECT conv_id, 'learned.missing_activations' FROM cut WHERE conv_id NOT IN (SELECT conv_id FROM active)),
counted AS (SELECT conv_id, c, count(*) AS n FROM problems GROUP BY ALL),
summed AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS errors, string_agg(c || ' ' || n, ';' ORDER BY c || ' ' || n) AS failed FROM counted GROUP BY conv_id)
SELECT conv_id, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, CAST(0 AS BIGINT) AS warnings, coalesce(failed, '') AS failed_checks
FROM recordings LEFT JOIN summed USING (conv_id)"""


@query
def stem_drift(t):
    """Cents per user, track and block as levels: where they leave the mean for too long."""
    cents = F.aggregate(F.get("samples", F.lit(0)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    levels = B.event_blocks(t).select("recording_id", "track", "block_index", cents.alias("level"))
    out = DR.change_alarms(levels, ["recording_id", "track"], "block_index", "level", 5_000, 60_000)
    return out.select(F.col("recording_id").cast("bigint").alias("user_id"), "track", "block_index", "direction", "excess")


ORACLES["stem_drift"] = f"""WITH {_GRID},
levels AS (SELECT user_id, track, block, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS level FROM valued GROUP BY ALL),
stepped AS (
  SELECT user_id, track, block, direction, CASE direction WHEN 'up' THEN off ELSE -off END - 5000 AS step
  FROM (SELECT *, level - CAST(floor(sum(level) OVER w / count(*) OVER w) AS BIGINT) AS off FROM levels WINDOW w AS (PARTITION BY user_id, track)),
    (SELECT unnest(['up', 'down']) AS direction)),
summed AS (SELECT *, sum(step) OVER (PARTITION BY user_id, track, direction ORDER BY block) AS c FROM stepped),
excesses AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY user_id, track, direction ORDER BY block)) AS excess FROM summed),
chained AS (SELECT *, coalesce(lag(excess) OVER (PARTITION BY user_id, track, direction ORDER BY block), 0) AS was FROM excesses)
SELECT user_id, track, block AS block_index, direction, CAST(excess AS BIGINT) AS excess FROM chained WHERE excess >= 60000 AND was < 60000"""


@query
def quality_by_genre(t):
    """Lengths by genre, sketched per shard (the source) and merged, beside the exact values."""
    shards = SK.sketch(t.documents.filter("lang is not null"), ["lang", "source"], "n_chars")
    found = SK.quantiles(SK.merged([shards.drop("source")], ["lang"]), ["lang"])
    exact = SK.exact_quantiles(t.documents.filter("lang is not null"), ["lang"], "n_chars")
    joined = found.join(exact, ["lang", "quantile"])
    close = F.abs(F.col("estimate") - F.col("exact")) <= SK.ACCURACY * F.col("exact") * (1 + 1e-9)
    return joined.select("lang", "quantile", "count", F.round("estimate", 6).alias("estimate"), "exact", close.alias("within"))


ORACLES["quality_by_genre"] = f"""WITH counted AS (SELECT lang, n_chars, count(*) AS n FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY n_chars) AS upto, sum(n) OVER (PARTITION BY lang) AS total FROM counted),
hit AS (
  SELECT lang, q, total, n_chars FROM ranked, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q)
  WHERE upto >= greatest(1, ceil(q * total)) AND upto - n < greatest(1, ceil(q * total)))
SELECT lang, q AS quantile, CAST(total AS BIGINT) AS count, CAST(n_chars AS DOUBLE) AS exact, true AS "within",
  round(CASE WHEN n_chars = 0 THEN 0.0 ELSE 2 * pow({SK.growth()!r}, ceil(ln(n_chars) / ln({SK.growth()!r}))) / ({SK.growth()!r} + 1) END, 6) AS estimate
FROM hit"""
