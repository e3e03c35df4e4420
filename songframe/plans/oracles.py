"""SQL equivalents of the registered queries, written for DuckDB from the operators' definitions."""

from __future__ import annotations

_SECTIONS = """
turns AS (SELECT conv_id, turn, role, length(text) AS chars FROM conversations),
sections AS (
  SELECT conv_id, turn, role,
    CAST(sum(chars) OVER w - chars AS DOUBLE) / 10 AS start_s, CAST(sum(chars) OVER w AS DOUBLE) / 10 AS end_s
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
recordings AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(chars) AS DOUBLE) / 10 AS duration,
    CAST(sum(chars) * 4410 AS BIGINT) AS frame_count
  FROM turns GROUP BY conv_id)"""

_BEATS = """
beats AS (
  SELECT DISTINCT conv_id, CAST((epoch_us(ts) // 1000) % (chars * 100) AS DOUBLE) / 1000 AS s
  FROM events JOIN recordings ON user_id = conv_id WHERE chars > 0)"""

_PASSAGES = """
inside AS (
  SELECT c.conv_id, c.turn, c.start_s, c.end_s, b.s,
    row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY b.s) AS n
  FROM sections c JOIN beats b ON b.conv_id = c.conv_id AND b.s > c.start_s AND b.s < c.end_s),
candidates AS (SELECT conv_id, turn, s, n // 2 AS k FROM inside WHERE n % 2 = 0),
walk AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS k, start_s AS last, false AS taken FROM sections
  UNION ALL
  SELECT w.conv_id, w.turn, c.k, CASE WHEN c.s - w.last >= 4.0 THEN c.s ELSE w.last END, c.s - w.last >= 4.0
  FROM walk w JOIN candidates c ON c.conv_id = w.conv_id AND c.turn = w.turn AND c.k = w.k + 1),
cuts AS (
  SELECT w.conv_id, w.turn, w.last AS s, c.end_s,
    row_number() OVER (PARTITION BY w.conv_id, w.turn ORDER BY w.last DESC) AS back
  FROM walk w JOIN sections c USING (conv_id, turn) WHERE w.taken),
edges AS (
  SELECT conv_id, turn, start_s AS s FROM sections
  UNION ALL SELECT conv_id, turn, s FROM cuts WHERE NOT (back = 1 AND end_s - s < 4.0)),
passages AS (
  SELECT e.conv_id, e.turn, e.s AS start_s,
    coalesce(lead(e.s) OVER (PARTITION BY e.conv_id, e.turn ORDER BY e.s), c.end_s) AS end_s
  FROM edges e JOIN sections c USING (conv_id, turn)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, start_s) - 1 AS idx FROM passages)"""


def _axis(config: str, n_fft: int, hop: int) -> str:
    return f"""
{config} AS (
  SELECT conv_id, unnest(range(CASE WHEN frame_count < {n_fft} THEN 0 ELSE (frame_count - {n_fft}) // {hop} + 1 END)) AS k
  FROM recordings),
{config}_centers AS (SELECT conv_id, CAST({n_fft // 2} + k * {hop} AS DOUBLE) / 44100 AS c FROM {config})"""


def _frame_range(config: str, n_fft: int, hop: int) -> str:
    return f"""WITH {_SECTIONS}, {_axis(config, n_fft, hop)}
SELECT s.conv_id, s.turn,
  count(CASE WHEN c < start_s THEN 1 END) AS start_frame, count(CASE WHEN c < end_s THEN 1 END) AS end_frame
FROM sections s LEFT JOIN {config}_centers x ON x.conv_id = s.conv_id
GROUP BY s.conv_id, s.turn"""


_STEMS = """
named AS (
  SELECT *, CASE event_type WHEN 'purchase' THEN 'vocals' WHEN 'click' THEN 'drums' WHEN 'signup' THEN 'bass'
      WHEN 'error' THEN 'other' ELSE event_type END AS stem,
    CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day
  FROM events),
required AS (SELECT unnest(['vocals', 'drums', 'bass', 'other']) AS stem)"""

_GRID = """
days AS (SELECT DISTINCT user_id, unnest(range((day // 8) * 8, (day // 8) * 8 + 8)) AS day FROM named),
grid AS (
  SELECT d.user_id, d.day,
    CAST(coalesce(sum(cents), 0) AS DOUBLE) AS mixture,
    CAST(coalesce(sum(cents) FILTER (stem = 'vocals'), 0) AS DOUBLE) AS vocals,
    CAST(coalesce(sum(cents) FILTER (stem = 'drums'), 0) AS DOUBLE) AS drums,
    CAST(coalesce(sum(cents) FILTER (stem = 'bass'), 0) AS DOUBLE) AS bass,
    CAST(coalesce(sum(cents) FILTER (stem = 'other'), 0) AS DOUBLE) AS other
  FROM days d LEFT JOIN named e ON e.user_id = d.user_id AND e.day = d.day GROUP BY d.user_id, d.day)"""

_SPECTRUM = """
samples AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
bins AS (SELECT unnest(range(33)) AS k),
spectrum AS (
  SELECT vec_id, k,
    sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * cos(2 * pi() * ((k * n) % 64) / 64)), 2)
       + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * sin(2 * pi() * ((k * n) % 64) / 64)), 2)) / 32 AS m
  FROM samples, bins GROUP BY vec_id, k)"""

_FILTERS = """
nearest AS (
  SELECT DISTINCT least(31, greatest(0, CAST(floor(f / 15.625 + 0.5) AS BIGINT))) AS b
  FROM (SELECT 440 * pow(2, i / 12.0) AS f FROM range(-47, 64) r(i)) WHERE f >= 30 AND f <= 500),
triples AS (SELECT b AS a, lead(b, 1) OVER (ORDER BY b) AS p, lead(b, 2) OVER (ORDER BY b) AS z FROM nearest),
bands AS (SELECT *, row_number() OVER (ORDER BY a) - 1 AS band FROM triples WHERE z IS NOT NULL),
shape AS (
  SELECT band, k, CASE WHEN k < p THEN CAST(k - a AS DOUBLE) / (p - a) ELSE CAST(z - k AS DOUBLE) / (z - p) END AS v
  FROM bands, (SELECT unnest(range(32)) AS k) WHERE k >= a AND k < z),
filters AS (SELECT band, k, CAST(CAST(v / sum(v) OVER (PARTITION BY band) AS FLOAT) AS DOUBLE) AS w FROM shape)"""

_STEM_BANDS = f"""
samples AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
grid AS (
  SELECT vec_id, f, n - (f * 16 - 32) AS n, x FROM samples, (SELECT unnest(range(4)) AS f)
  WHERE n - (f * 16 - 32) BETWEEN 0 AND 63),
spectrum AS (
  SELECT vec_id, f, k,
    sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * cos(2 * pi() * ((k * n) % 64) / 64)), 2)
       + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) * sin(2 * pi() * ((k * n) % 64) / 64)), 2)) AS m
  FROM grid, (SELECT unnest(range(32)) AS k) GROUP BY vec_id, f, k),
{_FILTERS},
features AS (
  SELECT vec_id // 4 AS song, (['bass', 'drums', 'other', 'vocals'])[vec_id % 4 + 1] AS track, f AS frame_index, band,
    round(CAST(CAST(log10(1 + sum(m * w)) AS FLOAT) AS DOUBLE), 5) AS energy
  FROM spectrum JOIN filters USING (k) GROUP BY vec_id, f, band)"""

_CATALOG = """
eligible AS (
  SELECT doc_id AS track_id, trim(lang) AS genre_top, source AS artist_id, n_chars,
    'fma_full/' || substr(printf('%06d', doc_id), 1, 3) || '/' || printf('%06d', doc_id) || '.mp3' AS archive_member
  FROM documents WHERE trim(lang) <> '' AND n_chars BETWEEN 120 AND 6000 AND doc_id % 7 <> 0)"""

_LABEL_FRAMES = """
framed AS (
  SELECT CAST(label AS BIGINT) AS song, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame
  FROM embeddings)"""

_USER_BEATS = """
ordered AS (
  SELECT user_id, value, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3.6e9 AS s,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i
  FROM events)"""

_CORRECTIONS = """
supplied AS (
  SELECT l.doc_id, quality, toxic, CAST(n_chars AS DOUBLE) / 10 AS duration,
    CAST(n_chars // 2 AS DOUBLE) / 10 AS half
  FROM labels l JOIN documents d USING (doc_id)),
problems AS (
  SELECT doc_id, 'different_base' AS "check" FROM supplied WHERE toxic = 1
  UNION ALL SELECT doc_id, 'confidence_out_of_range' FROM supplied WHERE quality = 0
  UNION ALL SELECT doc_id, 'non_positive' FROM supplied WHERE half <= 0
  UNION ALL SELECT doc_id, 'non_positive' FROM supplied WHERE duration <= half)"""

_TIMELINE_PROBLEMS = """
spoken AS (
  SELECT s.conv_id, turn, start_s, end_s, r.duration,
    coalesce(lag(end_s) OVER (PARTITION BY s.conv_id ORDER BY turn), 0) AS previous
  FROM sections s JOIN recordings r USING (conv_id) WHERE role <> 'system'),
ends AS (SELECT conv_id, max_by(end_s, turn) AS last_end FROM spoken GROUP BY conv_id),
problems AS (
  SELECT conv_id, 'discontinuous' AS "check", CAST(turn AS VARCHAR) AS subject FROM spoken WHERE abs(start_s - previous) > 1e-6
  UNION ALL SELECT conv_id, 'non_positive', CAST(turn AS VARCHAR) FROM spoken WHERE end_s <= start_s
  UNION ALL SELECT conv_id, 'past_end', CAST(turn AS VARCHAR) FROM spoken WHERE end_s > duration + 1e-6
  UNION ALL SELECT r.conv_id, CASE WHEN last_end IS NULL THEN 'missing_intervals' ELSE 'incomplete' END, 'timeline'
    FROM recordings r LEFT JOIN ends USING (conv_id) WHERE last_end IS NULL OR abs(last_end - duration) > 1e-6)"""

ORACLES: dict[str, str] = {
    "catalog_eligible": f"""WITH {_CATALOG}
SELECT track_id, archive_member, genre_top, artist_id, n_chars AS metadata_duration_seconds,
  'CC0 1.0 Universal' AS license FROM eligible""",
    "catalog_members": f"""WITH {_CATALOG}
SELECT track_id, genre_top FROM eligible WHERE track_id IN (SELECT doc_id FROM labels)""",
    "catalog_diverse_25": f"""WITH {_CATALOG},
drawn AS (SELECT *, sha256('7:' || track_id) AS draw FROM eligible),
flagged AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY artist_id ORDER BY draw) > 1 THEN 1 ELSE 0 END AS is_repeat FROM drawn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY genre_top ORDER BY is_repeat, draw) AS genre_rank FROM flagged)
SELECT track_id, genre_top, artist_id, is_repeat, genre_rank FROM ranked ORDER BY genre_rank, genre_top LIMIT 25""",
    "content_hash": """SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes,
  substr(sha256(text), 1, 16) AS recording_id FROM documents""",
    "recording_ids": """WITH named AS (
  SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS given, coalesce(given, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)) AS recording_id
  FROM orders)
SELECT o_orderkey, recording_id, regexp_full_match(recording_id, '[A-Za-z0-9][A-Za-z0-9._-]*') AS safe FROM named""",
    "config_violations": """
SELECT p_partkey, 'spectrogram' AS config, 'name_path_safe' AS rule FROM part
  WHERE length(p_name) = 0 OR contains(p_name, '/') OR contains(p_name, chr(92))
UNION ALL SELECT p_partkey, 'spectrogram', 'n_fft_power_of_two' FROM part
  WHERE NOT (p_size > 0 AND (CAST(p_size * 64 AS BIGINT) & CAST(p_size * 64 - 1 AS BIGINT)) = 0)
UNION ALL SELECT p_partkey, 'spectrogram', 'hop_in_window' FROM part
  WHERE NOT (trunc(p_retailprice) > 0 AND trunc(p_retailprice) <= p_size * 64)
UNION ALL SELECT p_partkey, 'spectrogram', 'minimum_db_negative' FROM part WHERE NOT (1000.0 - p_retailprice < 0)
UNION ALL SELECT p_partkey, 'canonical', 'sample_rate_positive' FROM part WHERE NOT (p_size - 10 > 0)
UNION ALL SELECT p_partkey, 'canonical', 'one_or_two_channels' FROM part WHERE p_size % 4 NOT IN (1, 2)
UNION ALL SELECT p_partkey, 'canonical', 'pcm_24_bit' FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT p_partkey, 'separation', 'stems_unique_nonempty' FROM (
    SELECT p_partkey, list_concat(string_split(p_name, ' '), list_transform(string_split(p_name, ' '), lambda w: lower(w))) AS stems
    FROM part) WHERE len(list_distinct(stems)) <> len(stems)
UNION ALL SELECT p_partkey, 'separation', 'error_limit_positive' FROM part WHERE NOT (p_size - 5 > 0)
UNION ALL SELECT p_partkey, 'passages', 'beats_positive' FROM part WHERE NOT (p_size - 20 > 0)
UNION ALL SELECT p_partkey, 'passages', 'minimum_positive' FROM part WHERE NOT (p_retailprice - 950 > 0)""",
    "config_digests": """SELECT p_partkey, sha256('{"hop_length":' || p_size || ',"n_fft":' || (p_size * 64) || ',"name":"' || p_type
  || '","window":"hann"}') AS config_sha256 FROM part""",
    "geometry_mismatch": """WITH actual AS (
  SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS channels,
    CASE WHEN o_orderstatus = 'F' THEN '44100' ELSE '48000' END AS rate,
    CASE WHEN o_totalprice > 200000 THEN '3' ELSE '2' END AS width FROM orders)
SELECT o_orderkey, 'channels' AS property, '2' AS expected, channels AS actual FROM actual WHERE channels <> '2'
UNION ALL SELECT o_orderkey, 'sample_rate_hz', '44100', rate FROM actual WHERE rate <> '44100'
UNION ALL SELECT o_orderkey, 'sample_width_bytes', '3', width FROM actual WHERE width <> '3'""",
    "timeline_sections": f"""WITH {_SECTIONS}
SELECT conv_id, turn, start_s AS start_seconds, end_s AS end_seconds,
  CAST(round_even(start_s * 44100, 0) AS BIGINT) AS start_sample,
  least(frame_count, CAST(round_even(end_s * 44100, 0) AS BIGINT)) AS end_sample
FROM sections JOIN recordings USING (conv_id)""",
    "timeline_violations": f"""WITH {_SECTIONS}, {_TIMELINE_PROBLEMS}
SELECT conv_id, "check", subject FROM problems""",
    "beat_order_violations": """WITH chained AS (
  SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT user_id, event_id, 'not_increasing' AS "check" FROM chained WHERE value <= previous
UNION ALL SELECT user_id, event_id, 'before_start' FROM chained WHERE value < 0
UNION ALL SELECT user_id, event_id, 'past_end' FROM chained WHERE value > 100""",
    "interval_pairs": f"""WITH {_SECTIONS}, {_BEATS},
paired AS (SELECT conv_id, lag(s) OVER (PARTITION BY conv_id ORDER BY s) AS start_seconds, s AS end_seconds FROM beats)
SELECT * FROM paired WHERE start_seconds IS NOT NULL""",
    "boundary_set": f"""WITH {_SECTIONS}, {_BEATS}
SELECT conv_id, greatest(0.0, least(duration, s - 5.0)) AS seconds FROM beats JOIN recordings USING (conv_id)
UNION SELECT conv_id, 0.0 FROM recordings UNION SELECT conv_id, duration FROM recordings""",
    "frame_range_transient": _frame_range("transient", 1024, 256),
    "frame_range_harmonic": _frame_range("harmonic", 4096, 1024),
    "spectrogram_axes": f"""WITH {_SECTIONS},
configs AS (SELECT 'transient' AS config, 1024 AS n_fft, 256 AS hop UNION ALL SELECT 'harmonic', 4096, 1024),
shaped AS (
  SELECT *, CASE WHEN frame_count < n_fft THEN 0 ELSE (frame_count - n_fft) // hop + 1 END AS frames FROM recordings, configs)
SELECT conv_id, config, CAST(n_fft // 2 + 1 AS INTEGER) AS frequency_bins, CAST(frames AS BIGINT) AS time_frames,
  CASE WHEN frames > 0 THEN CAST(n_fft // 2 AS DOUBLE) / 44100 END AS first_frame_center_seconds,
  CASE WHEN frames > 0 THEN CAST(n_fft // 2 + (frames - 1) * hop AS DOUBLE) / 44100 END AS last_frame_center_seconds
FROM shaped""",
    "passages_greedy": f"""WITH RECURSIVE {_SECTIONS}, {_BEATS}, {_PASSAGES}
SELECT conv_id, turn, start_s AS start_seconds, end_s AS end_seconds FROM numbered""",
    "passage_index": f"""WITH RECURSIVE {_SECTIONS}, {_BEATS}, {_PASSAGES}
SELECT conv_id, idx AS passage_index, start_s AS start_seconds FROM numbered""",
    "passages_aligned": f"""WITH RECURSIVE {_SECTIONS}, {_BEATS}, {_PASSAGES}, {_axis("transient", 1024, 256)}, {_STEMS},
present AS (
  SELECT user_id AS conv_id, count(DISTINCT stem) AS stems,
    max(CASE WHEN stem = 'vocals' THEN sha256(CAST(user_id AS VARCHAR) || '/vocals') END) AS vocals_sha256
  FROM named WHERE event_type <> 'view' GROUP BY user_id),
ranged AS (
  SELECT p.conv_id, p.idx, p.turn, p.start_s, p.end_s,
    count(CASE WHEN c < start_s THEN 1 END) AS start_frame, count(CASE WHEN c < end_s THEN 1 END) AS end_frame
  FROM numbered p LEFT JOIN transient_centers x ON x.conv_id = p.conv_id
  GROUP BY p.conv_id, p.idx, p.turn, p.start_s, p.end_s)
SELECT g.conv_id, idx AS passage_index, g.turn AS section_index, role AS section_label,
  CAST(round_even(g.start_s * 44100, 0) AS BIGINT) AS start_sample,
  least(frame_count, CAST(round_even(g.end_s * 44100, 0) AS BIGINT)) AS end_sample,
  start_frame, end_frame, coalesce(stems, 0) AS stems, vocals_sha256
FROM ranged g JOIN recordings USING (conv_id) JOIN sections s ON s.conv_id = g.conv_id AND s.turn = g.turn
LEFT JOIN present e ON e.conv_id = g.conv_id""",
    "downbeat_phase": f"""WITH {_USER_BEATS},
scored AS (SELECT user_id, i % 4 AS phase, avg(value) AS score FROM ordered GROUP BY user_id, i % 4),
best AS (SELECT user_id, phase, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, phase) AS r FROM scored),
sized AS (SELECT user_id, count(*) AS n FROM ordered GROUP BY user_id),
phases AS (SELECT b.user_id, CASE WHEN n >= 4 THEN phase END AS phase FROM best b JOIN sized USING (user_id) WHERE r = 1)
SELECT o.user_id, max(phase) AS downbeat_phase, count(CASE WHEN i >= phase AND (i - phase) % 4 = 0 THEN 1 END) AS downbeats
FROM ordered o JOIN phases USING (user_id) GROUP BY o.user_id""",
    "tempo_mode": f"""WITH {_USER_BEATS},
gaps AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM ordered),
counted AS (
  SELECT user_id, CAST(round_even(60.0 / gap, 0) AS BIGINT) AS bpm, count(*) AS n FROM gaps WHERE gap > 0 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, bpm) AS r FROM counted)
SELECT user_id, bpm AS tempo_bpm FROM ranked WHERE r = 1""",
    "onset_at_beats": """WITH hourly AS (
  SELECT user_id, event_id, CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
    (epoch_us(ts) - 1704067200000000) // 3600000000 AS hour FROM events),
frames AS (SELECT user_id, hour, CAST(sum(cents) AS BIGINT) AS onset FROM hourly GROUP BY user_id, hour),
sizes AS (SELECT user_id, max(hour) AS last FROM frames GROUP BY user_id),
beats AS (SELECT user_id, event_id, greatest(0, least(last, hour + 3)) AS hour FROM hourly JOIN sizes USING (user_id))
SELECT user_id, event_id, hour AS frame_index, onset FROM beats LEFT JOIN frames USING (user_id, hour)""",
    "count_rules": f"""WITH {_SECTIONS},
sized AS (
  SELECT conv_id, round(frame_count / CAST(44100 AS DOUBLE), 9) AS d, CAST(floor(duration * 44100 / 512) AS BIGINT) AS frames
  FROM recordings),
spanned AS (
  SELECT *, least(greatest(2, least(12, CAST(round_even(d / 20, 0) AS BIGINT))), frames) AS spans FROM sized),
grouped AS (SELECT *, least(4, greatest(1, CAST(round_even(sqrt(spans), 0) AS BIGINT))) AS groups FROM spanned)
SELECT conv_id, d AS duration_seconds, frames, spans, groups, 'section_' || chr(CAST(64 + groups AS INTEGER)) AS last_label
FROM grouped""",
    "corrected_structures": f"""WITH {_CORRECTIONS}
SELECT doc_id, 'correction:c' || doc_id AS hypothesis_id, 'human-corrected-structure' AS backend,
  'unsupervised-baseline' AS base_backend, 'baseline' AS base_hypothesis_id, sha256(text) AS base_manifest_sha256,
  'reviewer' AS annotator, duration AS duration_seconds, CAST(0 AS BIGINT) AS beat_index, duration AS beat_seconds
FROM supplied JOIN documents USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM problems)""",
    "stem_contract": f"""WITH {_STEMS},
daily AS (SELECT DISTINCT user_id || '-' || strftime(ts, '%Y%m%d') AS recording_id, stem FROM named),
songs AS (SELECT DISTINCT recording_id FROM daily)
SELECT recording_id, 'missing_stem' AS "check", stem FROM (
  SELECT recording_id, stem FROM songs, required EXCEPT SELECT recording_id, stem FROM daily)
UNION ALL SELECT recording_id, 'unexpected_stem', stem FROM daily WHERE stem NOT IN (SELECT stem FROM required)""",
    "stem_alignment": f"""WITH {_STEMS},
mixtures AS (SELECT user_id, max(day) + 1 AS frames FROM named GROUP BY user_id),
stems AS (SELECT user_id, stem, max(day) + 1 AS frames FROM named WHERE event_type <> 'view' GROUP BY user_id, stem)
SELECT s.user_id, 'frame_count' AS "check", stem, s.frames || ' != ' || m.frames AS detail
FROM stems s JOIN mixtures m USING (user_id) WHERE s.frames <> m.frames""",
    "stem_residual": f"""WITH {_STEMS}, {_GRID}
SELECT user_id, day, CAST(mixture - vocals - drums - bass - other AS BIGINT) AS residual FROM grid""",
    "reconstruction_metrics": f"""WITH {_STEMS}, {_GRID},
energy AS (
  SELECT user_id, sqrt(avg(mixture * mixture)) AS mix, sqrt(avg(pow(mixture - vocals - drums - bass - other, 2))) AS res,
    max(abs(mixture - vocals - drums - bass - other)) AS worst, max(abs(vocals)) AS pv, max(abs(drums)) AS pd, max(abs(bass)) AS pb, max(abs(other)) AS po
  FROM grid GROUP BY user_id)
SELECT user_id, round(mix, 6) AS mixture_rms, round(res, 6) AS residual_rms,
  round(res / greatest(mix, pow(2.0, -52)), 6) AS normalized_reconstruction_error,
  CASE WHEN res = 0 THEN CAST('inf' AS DOUBLE) ELSE round(20 * log10(greatest(mix, pow(2.0, -52)) / res), 6) END AS reconstruction_snr_db,
  round(worst, 6) AS maximum_absolute_residual, round(pv, 6) AS peak_vocals, round(pd, 6) AS peak_drums, round(pb, 6) AS peak_bass, round(po, 6) AS peak_other,
  res / greatest(mix, pow(2.0, -52)) <= 0.15 AS within_threshold
FROM energy""",
    "block_loudness": f"""WITH {_STEMS}, {_GRID},
tall AS (UNPIVOT grid ON mixture, vocals, drums, bass, other INTO NAME track VALUE x)
SELECT user_id, track, round(avg(x), 4) AS reference_mean,
  CASE WHEN stddev_samp(x) > 0 THEN round(stddev_samp(x), 4) END AS reference_std FROM tall GROUP BY user_id, track""",
    "loudness_normalise": """WITH stats AS (
  SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type),
scaled AS (SELECT event_id, m, s, (value - m) / s AS z FROM events JOIN stats USING (event_type))
SELECT event_id, round(z, 6) AS normalised, round(greatest(least(z / 200.0 * s + m, 0.99), -0.99), 6) AS restored,
  round(greatest(least(z, 0.99), -0.99), 6) AS clamped FROM scaled""",
    "pcm_mono": """SELECT l_orderkey, l_linenumber,
  (CAST(l_partkey AS DOUBLE) / 32768 + CAST(l_suppkey AS DOUBLE) / 32768) / 2 AS mono FROM lineitem""",
    "dft_magnitude": f"""WITH {_SPECTRUM}
SELECT vec_id, k AS bin, round(CAST(CAST(greatest(20 * log10(greatest(m, 1e-6)), -120) AS FLOAT) AS DOUBLE), 4) AS dbfs
FROM spectrum""",
    "framed_energy": """WITH starts AS (SELECT vec_id, embedding, unnest(range(13)) AS frame FROM embeddings)
SELECT vec_id, frame, round(list_sum(list_transform(embedding[frame * 4 + 1 : frame * 4 + 16],
  lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS energy FROM starts""",
    "spectrogram_summary": """SELECT vec_id, CAST((len(embedding) - 16) // 4 + 1 AS BIGINT) AS time_frames,
  CAST(9 AS BIGINT) AS frequency_bins, CAST(8 AS DOUBLE) / 44100 AS first_frame_center_seconds,
  CAST(8 + ((len(embedding) - 16) // 4) * 4 AS DOUBLE) / 44100 AS last_frame_center_seconds FROM embeddings""",
    "filterbank_bands": f"""WITH {_SPECTRUM}, {_FILTERS}
SELECT vec_id, band,
  round(log10(1 + CAST(CAST(sum(CAST(CAST(m AS FLOAT) AS DOUBLE) * w) AS FLOAT) AS DOUBLE)), 5) AS energy
FROM spectrum JOIN filters USING (k) GROUP BY vec_id, band""",
    "log_band_features": f"""WITH {_STEM_BANDS}
SELECT song, track, frame_index, band, energy FROM features""",
    "stacked_features": f"""WITH {_STEM_BANDS}
SELECT song, frame_index, max(energy) FILTER (track = 'bass') AS bass, max(energy) FILTER (track = 'drums') AS drums,
  max(energy) FILTER (track = 'other') AS other, max(energy) FILTER (track = 'vocals') AS vocals
FROM features WHERE band = 5 GROUP BY song, frame_index HAVING count(*) = 4""",
    "feature_shapes": f"""WITH {_FILTERS},
shaped AS (SELECT vec_id // 4 AS song, CAST(ceil(len(embedding) / 16.0) AS BIGINT) AS frames FROM embeddings)
SELECT song, count(*) AS stems, max(frames) AS frames, (SELECT count(*) FROM bands) AS bands, count(DISTINCT frames) AS shapes
FROM shaped GROUP BY song""",
    "onset_flux": """WITH paired AS (
  SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS previous FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, vec_id, round(coalesce(list_avg(list_transform(range(1, 65),
  lambda i: greatest(CAST(embedding[i] - previous[i] AS DOUBLE), 0.0))), 0.0), 6) AS onset
FROM (SELECT label, vec_id, embedding, previous FROM paired WHERE previous IS NOT NULL)
UNION ALL SELECT CAST(label AS BIGINT), vec_id, 0.0 FROM paired WHERE previous IS NULL""",
    "chroma_fold": f"""WITH {_SPECTRUM},
pitched AS (
  SELECT k, CAST(((round_even(12 * log2(k * 44100 / 64.0 / 440.0), 0) + 9) % 12 + 12) % 12 AS BIGINT) AS pitch_class
  FROM bins WHERE k > 0),
classes AS (SELECT unnest(range(12)) AS pitch_class),
folded AS (
  SELECT vec_id, pitch_class, CAST(sum(CAST(CAST(m AS FLOAT) AS DOUBLE)) AS FLOAT) AS x
  FROM spectrum JOIN pitched USING (k) GROUP BY vec_id, pitch_class),
dense AS (
  SELECT e.vec_id, c.pitch_class, CAST(coalesce(x, 0) AS DOUBLE) AS x
  FROM embeddings e CROSS JOIN classes c LEFT JOIN folded f ON f.vec_id = e.vec_id AND f.pitch_class = c.pitch_class)
SELECT vec_id, pitch_class, round(x / nullif(max(x) OVER (PARTITION BY vec_id), 0), 5) AS strength FROM dense""",
    "activation_probs": """WITH tall AS (
  SELECT vec_id, embedding, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
shifted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM tall)
SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS beat_probability, pos,
  round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability FROM shifted""",
    "section_distribution": f"""WITH {_LABEL_FRAMES},
tall AS (SELECT song, frame, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM framed)
SELECT song AS label, frame // 16 AS section_index, pos, round(avg(x), 6) AS mean FROM tall GROUP BY 1, 2, 3""",
    "label_top3": """WITH tall AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
shifted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM tall),
ranked AS (
  SELECT vec_id, pos, e / sum(e) OVER (PARTITION BY vec_id) AS p,
    row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, pos) - 1 AS rank FROM shifted)
SELECT vec_id, rank, printf('label_%02d', pos) AS label, round(p, 6) AS probability FROM ranked WHERE rank < 3""",
    "learned_sections": f"""WITH {_LABEL_FRAMES},
sizes AS (SELECT song, count(*) AS t, CAST(count(*) AS DOUBLE) / 100 AS duration FROM framed GROUP BY song),
segments AS (
  SELECT song, frame // 7 AS seg, CAST(min(frame) AS DOUBLE) / 100 AS a, CAST(max(frame) + 1 AS DOUBLE) / 100 AS z
  FROM framed GROUP BY song, frame // 7),
counted AS (SELECT song, count(*) AS n FROM segments GROUP BY song),
folded AS (
  SELECT s.song, seg - CASE WHEN n > 1 THEN 1 ELSE 0 END AS i,
    CASE WHEN n > 1 AND seg = 1 THEN 0.0 ELSE a END AS a,
    CASE WHEN n > 2 AND seg = n - 2 THEN duration ELSE z END AS z,
    CASE WHEN seg = 0 THEN 'start' WHEN seg = n - 1 THEN 'end'
      ELSE (['instrumental', 'verse', 'chorus', 'unheard'])[seg % 4 + 1] END AS label,
    CASE WHEN n > 2 THEN n - 2 WHEN n = 2 THEN 1 ELSE n END AS m, t, duration
  FROM segments s JOIN counted USING (song) JOIN sizes USING (song)
  WHERE NOT (n > 1 AND seg = 0) AND NOT (n > 2 AND seg = n - 1)),
snapped AS (
  SELECT song, i, label, t, CASE WHEN i = 0 THEN 0.0 ELSE least(a, duration) END AS a,
    CASE WHEN i = m - 1 THEN duration ELSE greatest(least(a, duration), least(z, duration)) END AS z FROM folded),
ranged AS (
  SELECT *, least(t - 1, greatest(0, CAST(round_even(a * 100, 0) AS BIGINT))) AS f0 FROM snapped),
spans AS (SELECT *, least(t, greatest(f0 + 1, CAST(round_even(z * 100, 0) AS BIGINT))) AS f1 FROM ranged),
logits AS (
  SELECT song, frame, generate_subscripts(embedding[1:10], 1) - 1 AS pos,
    CAST(CAST(CAST(unnest(embedding[1:10]) AS DOUBLE) * 10 AS FLOAT) AS DOUBLE) AS x FROM framed),
shifted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY song, frame)) AS e FROM logits),
probs AS (SELECT song, frame, pos, e / sum(e) OVER (PARTITION BY song, frame) AS p FROM shifted),
means AS (
  SELECT s.song, s.i, pos, avg(p) AS p FROM spans s JOIN probs q ON q.song = s.song AND q.frame >= f0 AND q.frame < f1
  GROUP BY s.song, s.i, pos),
named AS (
  SELECT *, (['start','end','intro','outro','break','bridge','instrumental','solo','verse','chorus'])[pos + 1] AS name,
    row_number() OVER (PARTITION BY song, i ORDER BY p DESC, pos) AS r FROM means),
tops AS (
  SELECT song, i, max(p) AS best, max(name) FILTER (r = 1) AS n1, max(name) FILTER (r = 3) AS n3, max(p) FILTER (r = 2) AS p2
  FROM named GROUP BY song, i)
SELECT s.song, s.i AS section_index, s.a AS start_seconds, s.z AS end_seconds,
  CAST(round_even(s.a * 44100, 0) AS BIGINT) AS start_sample,
  least(s.t * 441, CAST(round_even(s.z * 44100, 0) AS BIGINT)) AS end_sample, s.label,
  round(coalesce((SELECT p FROM named n WHERE n.song = s.song AND n.i = s.i AND n.name = s.label), best), 6) AS confidence,
  round(1 / (1 + exp(-CAST(f.embedding[13] AS DOUBLE))), 6) AS boundary_confidence,
  n1 AS first_label, n3 AS third_label, round(p2, 6) AS second_probability
FROM spans s JOIN tops USING (song, i) JOIN framed f ON f.song = s.song AND f.frame = s.f0""",
    "marker_fold": f"""WITH {_SECTIONS},
counted AS (SELECT conv_id, count(*) AS n FROM sections GROUP BY conv_id),
kept AS (
  SELECT s.conv_id, turn, n, start_s, end_s, duration,
    CASE WHEN turn = 0 THEN 'start' WHEN turn = n - 1 THEN 'end' WHEN role = 'assistant' THEN 'instrumental' ELSE role END AS label
  FROM sections s JOIN counted USING (conv_id) JOIN recordings USING (conv_id))
SELECT conv_id, turn - CASE WHEN n > 1 THEN 1 ELSE 0 END AS section_index,
  CASE WHEN n > 1 AND turn = 1 THEN 0.0 ELSE start_s END AS start,
  CASE WHEN n > 2 AND turn = n - 2 THEN duration ELSE end_s END AS "end", label
FROM kept WHERE NOT (n > 1 AND turn = 0) AND NOT (n > 2 AND turn = n - 1)""",
    "apply_corrections": f"""WITH {_CORRECTIONS},
accepted AS (
  SELECT *, CAST(round_even(duration * 44100, 0) AS BIGINT) AS frames FROM supplied
  WHERE doc_id NOT IN (SELECT doc_id FROM problems)),
parts AS (
  SELECT doc_id, frames, 0 AS i, 0.0 AS a, half AS z, 'intro' AS label, 1.0 AS confidence FROM accepted
  UNION ALL SELECT doc_id, frames, 1, half, duration, 'verse', 0.5 FROM accepted)
SELECT doc_id, 'correction:c' || doc_id AS hypothesis_id, CAST(i AS BIGINT) AS section_index,
  CAST(a AS DOUBLE) AS start_seconds, z AS end_seconds, label, 'human_annotation' AS label_kind,
  CAST(confidence AS DOUBLE) AS confidence, CAST(round_even(a * 44100, 0) AS BIGINT) AS start_sample,
  least(frames, CAST(round_even(z * 44100, 0) AS BIGINT)) AS end_sample FROM parts""",
    "correction_problems": f"""WITH {_CORRECTIONS}
SELECT doc_id, "check", 'c' || doc_id AS correction_id FROM problems""",
    "lineage_problems": """
SELECT CAST(doc_id AS VARCHAR) AS recording_id, 'lineage_mismatch' AS "check", 'label<-wave:mixture' AS subject
FROM labels JOIN documents USING (doc_id) WHERE quality <> 1 AND text <> lang
UNION ALL SELECT 'b' || item_id, 'missing_parent', 'item<-wave:mixture' FROM benchmark""",
    "validation_report": f"""WITH {_SECTIONS}, {_BEATS}, {_STEMS}, {_TIMELINE_PROBLEMS},
errors AS (SELECT conv_id, count(*) AS errors, count(DISTINCT "check") AS failed FROM problems GROUP BY conv_id),
present AS (SELECT DISTINCT user_id AS conv_id, stem FROM named),
warned AS (
  SELECT conv_id, stem FROM (SELECT conv_id, stem FROM recordings, required EXCEPT SELECT conv_id, stem FROM present)
  UNION ALL SELECT conv_id, stem FROM present WHERE stem NOT IN (SELECT stem FROM required)),
warnings AS (SELECT conv_id, count(*) AS warnings FROM warned GROUP BY conv_id),
section_counts AS (SELECT conv_id, count(*) AS n FROM sections GROUP BY conv_id),
beat_counts AS (SELECT conv_id, count(*) AS n FROM beats GROUP BY conv_id)
SELECT r.conv_id, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
  coalesce(failed, 0) AS failed_checks, coalesce(s.n, 0) AS section_count, coalesce(b.n, 0) AS beat_count
FROM recordings r LEFT JOIN errors USING (conv_id) LEFT JOIN warnings USING (conv_id)
LEFT JOIN section_counts s USING (conv_id) LEFT JOIN beat_counts b USING (conv_id)""",
}
