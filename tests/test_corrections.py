import hashlib
import json

from pyspark.sql import functions as F

from songframe.operators import corrections as CR
from songframe.sources import manifests as MF

BASE_SHA, OTHER_SHA = (hashlib.sha256(x).hexdigest() for x in (b"first take", b"second take"))
SECTIONS = [{"start_seconds": 0, "end_seconds": 5.5, "label": "opening"}, {"start_seconds": 5.5, "end_seconds": 13, "label": "closing"}]


def document(**changes):
    value = {"schema": "structure-correction/v1", "annotator": "ear-7", "created_at": "2030-02-03T04:05:06.5+07:00", "sections": SECTIONS}
    value.update(changes)
    return json.dumps({k: v for k, v in value.items() if v is not None})


def section(i, **changes):
    return [{**s, **(changes if k == i else {})} for k, s in enumerate(SECTIONS)]


BASES = "recording_id string, hypothesis_id string, sha256 string, duration_seconds double, backend string, tempo_bpm double"


def setup(spark):
    bases = spark.createDataFrame([("song", "baseline", BASE_SHA, 13.0, "test", 96.0)], BASES)
    beats = spark.createDataFrame([("song", "baseline", i, 0.7 * i, i == 2) for i in range(4)],
                                  "recording_id string, hypothesis_id string, beat_index bigint, seconds double, is_downbeat boolean")
    recordings = spark.createDataFrame([("song", 200, 2_600)], "recording_id string, sample_rate_hz int, frame_count bigint")
    return bases, beats, recordings


def parse(spark, documents):
    rows = [(name, "song" if name != "orphan" else "other", text) for name, text in documents.items()]
    return MF.parse_corrections(spark.createDataFrame(rows, "correction_id string, recording_id string, text string"))


def test_accepted_correction_realigns_and_keeps_beats(spark):
    """5.5 s are 1,100 samples at 200 Hz; frames are 0.4 s apart, so frame 14 at 5.6 s is the first after."""
    bases, beats, recordings = setup(spark)
    meta = spark.createDataFrame([("song", "mixture", "coarse", 0, 80, 200, 33)],
                                 "recording_id string, track string, config string, n_fft int, hop_length int, sample_rate_hz int, time_frames bigint")
    sections = [SECTIONS[0] | {"confidence": 0.25}, SECTIONS[1] | {"notes": "slower"}]
    done = CR.apply_corrections(parse(spark, {"c9": document(base_manifest_sha256=BASE_SHA, sections=sections)}), bases, beats, recordings, meta)
    assert done.violations.count() == 0
    first, second = done.sections.orderBy("section_index").collect()
    assert (first.label, first.confidence, first.notes, first.end_sample) == ("opening", 0.25, None, 1_100)
    assert (second.label, second.confidence, second.notes, second.end_sample) == ("closing", 1.0, "slower", 2_600)
    assert first.spectrogram_frames["coarse"].end == second.spectrogram_frames["coarse"].start == 14
    assert {first.label_kind, second.label_kind} == {CR.LABEL_KIND}
    assert {(r.hypothesis_id, r.beat_index, r.is_downbeat) for r in done.beats.collect()} == {("correction:c9", i, i == 2) for i in range(4)}
    made = done.structures.first()
    assert (made.hypothesis_id, made.backend, made.base_backend, made.tempo_bpm) == ("correction:c9", CR.BACKEND_NAME, "test", 96.0)
    assert (made.annotator, made.base_manifest_sha256) == ("ear-7", BASE_SHA)


def test_several_hypotheses_of_one_recording(spark):
    bases, beats, recordings = setup(spark)
    bases = bases.union(spark.createDataFrame([("song", "learned", OTHER_SHA, 13.0, "net", 97.0)], BASES))
    texts = {"by_hash": document(base_manifest_sha256=OTHER_SHA), "none": document(), "wrong": document(base_manifest_sha256="0" * 64)}
    done = CR.apply_corrections(parse(spark, texts), bases, beats, recordings)
    assert {(r.subject, r.check) for r in done.violations.collect()} == {
        ("none", "ambiguous_base"), ("wrong", "ambiguous_base"), ("wrong", "different_base")}
    made = done.structures.collect()
    assert [(r.hypothesis_id, r.base_backend, r.base_hypothesis_id, r.tempo_bpm) for r in made] == [("correction:by_hash", "net", "learned", 97.0)]
    named = parse(spark, {"named": document()}).withColumn("base_hypothesis_id", F.lit("baseline"))
    done = CR.apply_corrections(named, bases, beats, recordings)
    assert [(r.base_hypothesis_id, r.base_manifest_sha256) for r in done.structures.collect()] == [("baseline", BASE_SHA)]
    assert done.violations.count() == 0 and done.beats.count() == 4


def test_every_problem_is_named(spark):
    bases, beats, recordings = setup(spark)
    cases = {
        "gap": (document(sections=section(1, start_seconds=6)), "discontinuous"),
        "short": (document(sections=section(1, end_seconds=12)), "incomplete"),
        "late": (document(sections=section(1, end_seconds=14)), "past_end"),
        "flat": (document(sections=section(0, end_seconds=0)), "non_positive"),
        "label": (document(sections=section(0, label="")), "empty_label"),
        "sure": (document(sections=section(0, confidence=1.5)), "confidence_out_of_range"),
        "extra": (document(sections=section(0, mood="sad")), "unknown_key"),
        "extra2": (document(reviewed=True), "unknown_key"),
        "schema": (document(schema="other/v1"), "wrong_schema"),
        "prefixed": (document(schema="vendor.structure-correction/v1"), None),
        "base": (document(base_manifest_sha256="0" * 64), "different_base"),
        "hash": (document(base_manifest_sha256="xyz"), "malformed_base_hash"),
        "nobody": (document(annotator=""), "missing_annotator"),
        "when": (document(created_at="yesterday"), "invalid_created_at"),
        "none": (document(sections=[]), "no_sections"),
        "orphan": (document(), "missing_base"),
        "text": ("not json", "wrong_schema"),
    }
    done = CR.apply_corrections(parse(spark, {k: v[0] for k, v in cases.items()}), bases, beats, recordings)
    found = {}
    for r in done.violations.collect():
        found.setdefault(r.subject, set()).add(r.check)
    for name, (_, check) in cases.items():
        assert (check in found[name]) if check else name not in found, (name, found.get(name))
    assert {r.hypothesis_id for r in done.sections.collect()} == {"correction:prefixed"}


def test_reading_from_folders(spark, tmp_path):
    folder = tmp_path / "song"
    folder.mkdir()
    (folder / "fix-1.json").write_text(document())
    row = MF.read_corrections(spark, str(tmp_path)).first()
    assert (row.correction_id, row.recording_id, len(row.sections), row.unknown_keys) == ("fix-1", "song", 2, [])


def test_stream_applies_each_correction_once(spark, tmp_path):
    from songframe.streaming.corrections import publish_corrections

    bases, beats, recordings = setup(spark)
    landing = tmp_path / "landing" / "song"
    landing.mkdir(parents=True)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        query = publish_corrections(spark, str(tmp_path / "landing"), bases, beats, recordings, out, check)
        query.awaitTermination(120)
        return spark.read.parquet(f"{out}/sections").count()

    (landing / "a.json").write_text(document())
    assert drain() == 2
    (landing / "b.json").write_text(document(annotator="other"))
    (landing / "c.json").write_text(document(sections=section(1, start_seconds=6)))
    assert drain() == 4
    assert drain() == 4
    assert {r.check for r in spark.read.parquet(f"{out}/violations").collect()} == {"discontinuous"}
    for table, rows in (("structures", 2), ("beats", 8), ("violations", 1)):
        assert spark.read.parquet(f"{out}/{table}").count() == rows
    # a lost source checkpoint replays every file
    query = publish_corrections(spark, str(tmp_path / "landing"), bases, beats, recordings, out, str(tmp_path / "again"))
    query.awaitTermination(120)
    for table, rows in (("sections", 4), ("structures", 2), ("beats", 8), ("violations", 1)):
        assert spark.read.parquet(f"{out}/{table}").count() == rows


def test_stream_waits_for_bases(spark, tmp_path):
    from songframe.streaming.corrections import publish_when_based

    bases, beats, recordings = setup(spark)
    landing, table = tmp_path / "landing" / "song", str(tmp_path / "bases")
    landing.mkdir(parents=True)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    bases.withColumn("recording_id", F.lit("another")).write.parquet(table)

    def drain():
        publish_when_based(spark, str(tmp_path / "landing"), table, beats, recordings, out, check).awaitTermination(180)
        try:
            return spark.read.parquet(f"{out}/sections").count(), spark.read.parquet(f"{out}/violations").count()
        except Exception:  # nothing written yet
            return 0, 0

    (landing / "a.json").write_text(document())
    assert drain() == (0, 0)  # not judged, so no missing_base either
    bases.write.mode("append").parquet(table)
    assert drain() == (2, 0)
    (landing / "b.json").write_text(document(annotator="other"))
    (landing / "c.json").write_text(document(sections=section(1, start_seconds=6)))
    assert drain() == (4, 1)
    assert drain() == (4, 1)


def test_impossible_dates_are_no_instants(spark):
    texts = ["2030-02-03T04:05:06.5+07:00", "2030-02-03t04:05:06z", "2030-99-03T04:05:06Z", "2030-02-30T00:00:00Z", "2030-02-03T25:00:00Z", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.at for r in df.select(CR.created_timestamp(F.col("t")).cast("string").alias("at")).collect()]
    assert got == ["2030-02-02 21:05:06.5", "2030-02-03 04:05:06", None, None, None, None]
