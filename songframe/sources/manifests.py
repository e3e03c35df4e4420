"""Stage manifests and correction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe import schemas
from songframe.operators import timeline as TL

# The keys a correction may hold, at the top and per section.
CORRECTION_KEYS = ("schema", "base_manifest_sha256", "annotator", "created_at", "sections")
SECTION_KEYS = ("start_seconds", "end_seconds", "label", "confidence", "notes")


def read_manifests(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """JSON manifests of one stage with a declared schema; malformed ones land in ``_bad``."""
    return (
        spark.read.schema(f"{schema}, _bad string")
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )


def parse_corrections(documents: DataFrame) -> DataFrame:
    """Correction rows from raw JSON text.

    ``documents``: correction_id, recording_id, text. Keys the schema does not name are listed in
    ``unknown_keys``; text that is no JSON object gives null fields, which fail the later checks.
    """
    fields = schemas.CORRECTIONS.split(", ", 2)[2]
    parsed = F.from_json("text", fields)
    top = F.map_keys(F.from_json("text", "map<string,string>"))
    inner = F.flatten(
        F.transform(
            F.from_json(F.get_json_object("text", "$.sections"), "array<map<string,string>>"),
            lambda m: F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in SECTION_KEYS])),
        )
    )
    outer = F.array_except(top, F.array(*[F.lit(k) for k in CORRECTION_KEYS]))
    none = F.array().cast("array<string>")
    return documents.select(
        "correction_id",
        "recording_id",
        parsed.alias("p"),
        F.concat(F.coalesce(outer, none), F.coalesce(inner, none)).alias("unknown_keys"),
        F.sha2("text", 256).alias("correction_sha256"),
    ).select("correction_id", "recording_id", "p.*", "unknown_keys", "correction_sha256")


def correction_documents(files: DataFrame) -> DataFrame:
    """Name a correction after its file and its recording after the folder the file lies in.

    ``files``: path, value (whole text).
    """
    parts = F.split("path", "/")
    return files.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.json\z", "").alias("correction_id"),
        F.element_at(parts, -2).alias("recording_id"),
        F.col("value").alias("text"),
    )


def read_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections from ``folder/<recording>/<correction>.json``."""
    files = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_corrections(correction_documents(files))


def malformed(manifests: DataFrame, stage: str) -> DataFrame:
    """Violations for manifests that could not be parsed."""
    return manifests.filter(F.col("_bad").isNotNull()).select(
        "recording_id", *TL.violation(stage, "malformed_manifest", "manifest", F.col("_bad"))
    )
