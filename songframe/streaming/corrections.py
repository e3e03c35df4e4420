"""Corrections arriving as files, judged and appended batch by batch."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from songframe.operators.corrections import Corrected, apply_corrections
from songframe.sources.manifests import correction_documents, parse_corrections
from songframe.sources.sinks import append_new


def arriving_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed corrections from a landing folder ``<folder>/<recording>/<correction>.json``."""
    files = (
        spark.readStream.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .schema("value string")
        .format("text")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_corrections(correction_documents(files))


def _append(corrected: Corrected, output: str) -> None:
    hypothesis = ["recording_id", "hypothesis_id"]
    append_new(corrected.sections.drop("spectrogram_frames"), f"{output}/sections", hypothesis)
    append_new(corrected.beats, f"{output}/beats", hypothesis)
    append_new(corrected.structures, f"{output}/structures", hypothesis)
    append_new(corrected.violations, f"{output}/violations", ["recording_id", "stage", "check", "subject"])


def publish_corrections(
    spark: SparkSession,
    folder: str,
    bases: DataFrame,
    beats: DataFrame,
    recordings: DataFrame,
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Apply every arriving correction once: its structure, beats, sections and violations.

    The source remembers files by name; what was already written is skipped by hypothesis, and
    violations by correction and check, so a repeated batch after a lost driver adds nothing twice.
    """
    def apply(batch: DataFrame, _: int) -> None:
        _append(apply_corrections(batch, bases, beats, recordings), output)

    return (
        arriving_corrections(spark, folder)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _released(key: tuple, parts, state):
    """Pass a recording's corrections on once it has a base; until then they wait in its state."""
    based, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (False, [])
    for rows in parts:
        based = based or bool(rows["payload"].isna().any())
        waiting += rows["payload"].dropna().tolist()
    state.update((based, "[]" if based else json.dumps(waiting)))
    if based and waiting:
        yield pd.DataFrame({"recording_id": key[0], "payload": sorted(waiting)})


def with_known_base(corrections: DataFrame, bases: DataFrame) -> DataFrame:
    """The rows of a stream of corrections, each as soon as its recording has a row in the stream of bases.

    Both orders give the same rows: a correction that comes first is kept in keyed state, which Spark
    checkpoints, until the base arrives. A recording's state holds what waits for it and nothing once it
    is based. A correction without a recording never has a base.
    """
    rows = corrections.filter(F.col("recording_id").isNotNull()).select("recording_id", F.to_json(F.struct(*corrections.columns)).alias("payload"))
    known = bases.filter(F.col("recording_id").isNotNull()).select("recording_id", F.lit(None).cast("string").alias("payload"))
    released = rows.unionByName(known).groupBy("recording_id").applyInPandasWithState(
        _released, "recording_id string, payload string", "based boolean, waiting string", "append", GroupStateTimeout.NoTimeout
    )
    return released.select(F.from_json("payload", corrections.schema).alias("c")).select("c.*")


def publish_when_based(
    spark: SparkSession,
    folder: str,
    bases_path: str,
    beats: DataFrame,
    recordings: DataFrame,
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """``publish_corrections`` where bases arrive as well, before or after their corrections.

    ``bases_path`` is a Parquet table of bases that grows; it has to hold at least one file. A batch judges the
    corrections it releases against all bases there are by then, so a correction that names a later base
    of the same recording is judged when the first one is there.
    """
    schema = spark.read.parquet(bases_path).schema

    def apply(batch: DataFrame, _: int) -> None:
        _append(apply_corrections(batch, spark.read.schema(schema).parquet(bases_path), beats, recordings), output)

    ready = with_known_base(arriving_corrections(spark, folder), spark.readStream.schema(schema).parquet(bases_path))
    return ready.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
