"""Human corrections: checks, lineage and replacement of the section hypothesis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songframe.functions import exprs as X
from songframe.operators import timeline as TL
from songframe.operators.joins import attach

# Schema name (a vendor prefix is allowed), hash pattern, label kind.
CORRECTION_SCHEMA = r"\A([a-z0-9-]+\.)?structure-correction/v1\z"
SHA256_PATTERN = r"\A[0-9a-f]{64}\z"
# RFC 3339 date-time.
DATE_TIME_PATTERN = r"\A\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
LABEL_KIND = "human_annotation"
BACKEND_NAME = "human-corrected-structure"

KEYS = ["recording_id", "hypothesis_id"]


def _check(name: str, bad: Column, detail: Column) -> Column:
    """A (check, detail) pair when the condition holds; an unknown outcome counts as bad."""
    return F.when(
        F.coalesce(bad, F.lit(True)),
        F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")),
    )


def _section_checks(section: Column, index: Column) -> Column:
    sections = F.col("sections")
    previous = F.when(index == 0, F.lit(0.0)).otherwise(F.get(sections, index - 1)["end_seconds"])
    start, end = section["start_seconds"], section["end_seconds"]
    detail = F.concat_ws(":", index, start, end)
    return F.array(
        _check("discontinuous", F.abs(start - previous) > X.TOLERANCE, detail),
        _check("non_positive", end <= start, detail),
        _check("past_end", end > F.col("duration_seconds") + X.TOLERANCE, detail),
        _check("negative_start", start < 0, detail),
        _check("empty_label", F.length(section["label"]) < 1, detail),
        _check(
            "confidence_out_of_range",
            section["confidence"].isNotNull() & ~section["confidence"].between(0.0, 1.0),
            detail,
        ),
    )


def created_timestamp(text: Column) -> Column:
    """The instant that an RFC 3339 text names; null where there is none, as in month 13."""
    return F.try_to_timestamp(F.upper(text))


def judge_corrections(corrections: DataFrame, bases: DataFrame) -> DataFrame:
    """Each correction next to its base with the list of its problems.

    ``bases`` has a row per hypothesis: recording_id, hypothesis_id, sha256, duration_seconds, backend.
    A correction's base is the hypothesis it names in ``base_hypothesis_id`` (where the table has that
    column), else the one with the hash it claims, else the recording's only one. All section checks
    run inside the document's own array, so no window is needed.
    """
    one = F.struct(
        F.col("hypothesis_id").alias("base_hypothesis_id"),
        F.col("sha256").alias("actual_sha256"),
        "duration_seconds",
        F.col("backend").alias("base_backend"),
    )
    listed = bases.groupBy("recording_id").agg(F.sort_array(F.collect_list(one)).alias("__bases"))
    joined = corrections.join(listed, "recording_id", "left").withColumn("__bases", F.coalesce("__bases", F.array().cast(listed.schema["__bases"].dataType)))
    named = F.col("base_hypothesis_id") if "base_hypothesis_id" in corrections.columns else F.lit(None).cast("string")
    joined = joined.withColumn("__named", named).drop("base_hypothesis_id")
    asked = F.filter("__bases", lambda x: F.col("__named").isNull() | (x["base_hypothesis_id"] == F.col("__named")))
    exact = F.filter(asked, lambda x: x["actual_sha256"] == F.col("base_manifest_sha256"))
    fitting = F.when(F.size(exact) > 0, exact).otherwise(asked)
    only = F.when(F.size("__fit") == 1, F.get("__fit", F.lit(0)))
    joined = joined.withColumn("__fit", fitting).withColumns({
        "base_hypothesis_id": only["base_hypothesis_id"],
        "actual_sha256": only["actual_sha256"],
        "duration_seconds": F.coalesce(only["duration_seconds"], F.get("__bases", F.lit(0))["duration_seconds"]),
        "base_backend": only["base_backend"],
        "__n": F.size("__fit"),
        "__same": F.size(exact),
    }).drop("__bases", "__fit", "__named")
    claimed = F.col("base_manifest_sha256")
    last_end = F.get(F.col("sections"), F.size("sections") - 1)["end_seconds"]
    document = F.array(
        _check("wrong_schema", ~F.col("schema").rlike(CORRECTION_SCHEMA), F.col("schema")),
        _check("missing_base", F.col("__n") == 0, F.col("recording_id")),
        _check("ambiguous_base", F.col("__n") > 1, F.col("recording_id")),
        _check(
            "malformed_base_hash", claimed.isNotNull() & ~claimed.rlike(SHA256_PATTERN), claimed
        ),
        _check(
            "different_base",
            claimed.isNotNull() & (F.col("__n") > 0) & (F.col("__same") == 0),
            claimed,
        ),
        _check("missing_annotator", F.length("annotator") < 1, F.col("annotator")),
        _check("invalid_created_at", ~F.col("created_at").rlike(DATE_TIME_PATTERN) | created_timestamp(F.col("created_at")).isNull(), F.col("created_at")),
        _check("no_sections", F.size("sections") < 1, F.lit(None).cast("string")),
        _check(
            "incomplete",
            F.col("duration_seconds").isNotNull()
            & (F.size("sections") > 0)
            & (F.abs(last_end - F.col("duration_seconds")) > X.TOLERANCE),
            last_end,
        ),
    )
    per_section = F.flatten(
        F.transform(F.coalesce("sections", F.array()), lambda s, i: _section_checks(s, i))
    )
    judged = joined.withColumn(
        "problems", F.filter(F.concat(document, per_section), lambda p: p.isNotNull())
    )
    judged = judged.drop("__n", "__same")
    if "unknown_keys" in corrections.columns:
        extra = F.transform(
            F.coalesce("unknown_keys", F.array()),
            lambda k: F.struct(F.lit("unknown_key").alias("check"), k.cast("string").alias("detail")),
        )
        judged = judged.withColumn("problems", F.concat("problems", extra))
    return judged


@dataclass(frozen=True)
class Corrected:
    structures: DataFrame
    sections: DataFrame
    beats: DataFrame
    violations: DataFrame


def correction_violations(judged: DataFrame) -> DataFrame:
    return judged.withColumn("__p", F.explode("problems")).select(
        "recording_id",
        *TL.violation("correction", F.col("__p.check"), F.col("correction_id"), F.col("__p.detail")),
    )


def corrected_hypothesis(correction_id: Column) -> Column:
    return F.concat(F.lit("correction:"), correction_id)


def corrected_sections(accepted: DataFrame) -> DataFrame:
    """One row per supplied section, with the defaults filled in."""
    return accepted.select(
        "recording_id",
        corrected_hypothesis(F.col("correction_id")).alias("hypothesis_id"),
        F.posexplode("sections").alias("at", "s"),
    ).select(
        *KEYS,
        F.col("at").cast("bigint").alias("section_index"),
        F.col("s.start_seconds").alias("start_seconds"),
        F.col("s.end_seconds").alias("end_seconds"),
        F.col("s.label").alias("label"),
        F.lit(LABEL_KIND).alias("label_kind"),
        F.coalesce("s.confidence", F.lit(1.0)).alias("confidence"),
        F.col("s.notes").alias("notes"),
    )


def apply_corrections(
    corrections: DataFrame,
    bases: DataFrame,
    beats: DataFrame,
    recordings: DataFrame,
    meta: DataFrame | None = None,
) -> Corrected:
    """New hypotheses made of the corrected sections and the base's beats and scalars.

    A correction with any problem is reported and changes nothing; the base stays as it was.
    """
    judged = judge_corrections(corrections, bases)
    accepted = judged.filter(F.size("problems") == 0)
    sections = TL.align_intervals(corrected_sections(accepted), recordings, meta, "section_index")

    lineage = accepted.select(
        "recording_id",
        "base_hypothesis_id",
        corrected_hypothesis(F.col("correction_id")).alias("__new"),
        F.col("actual_sha256").alias("base_manifest_sha256"),
        "correction_id",
        "annotator",
        "created_at",
        created_timestamp(F.col("created_at")).alias("created"),
    )
    kept = [c for c in bases.columns if c not in ("recording_id", "hypothesis_id", "backend")]
    of_base = bases.withColumnRenamed("hypothesis_id", "base_hypothesis_id")
    structures = of_base.join(lineage, ["recording_id", "base_hypothesis_id"]).select(
        "recording_id",
        F.col("__new").alias("hypothesis_id"),
        F.lit(BACKEND_NAME).alias("backend"),
        F.col("backend").alias("base_backend"),
        *kept,
        "base_hypothesis_id",
        "base_manifest_sha256",
        "correction_id",
        "annotator",
        "created_at",
        "created",
    )
    moved = (
        attach(
            beats.withColumnRenamed("hypothesis_id", "base_hypothesis_id"),
            lineage.select("recording_id", "base_hypothesis_id", "__new"),
            ["recording_id", "base_hypothesis_id"],
            "beat_index",
            "inner",
        )
        .withColumn("hypothesis_id", F.col("__new"))
        .select(*beats.columns)
    )
    return Corrected(structures, sections, moved, correction_violations(judged))
