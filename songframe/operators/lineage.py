"""Claimed parent hashes against the hashes the parents really have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songframe.operators import timeline as TL
from songframe.operators.joins import attach


def lineage_violations(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges whose claim is not the parent's actual hash, or whose parent does not exist.

    ``edges``: recording_id, stage, child, parent_kind, claimed_sha256.
    ``artifacts``: recording_id, parent_kind, sha256 (one row per recording and kind).
    """
    joined = attach(edges, artifacts, ["recording_id", "parent_kind"], "child")
    return joined.filter(~F.col("claimed_sha256").eqNullSafe(F.col("sha256"))).select(
        "recording_id",
        *[
            F.col("stage"),
            F.when(F.col("sha256").isNull(), F.lit("missing_parent")).otherwise(F.lit("lineage_mismatch")).alias("check"),
            F.concat_ws("<-", "child", "parent_kind").alias("subject"),
            F.lit("error").alias("severity"),
            F.col("claimed_sha256").alias("detail"),
        ],
    )


def hash_violations(claimed: DataFrame, measured: DataFrame, stage: str) -> DataFrame:
    """Files whose content no longer has the recorded hash, or that are gone.

    ``claimed``: recording_id, subject, path, sha256. ``measured``: path, sha256.
    """
    found = measured.select("path", F.col("sha256").alias("__actual"))
    return (
        claimed.join(found, "path", "left")
        .filter(~F.col("sha256").eqNullSafe(F.col("__actual")))
        .select(
            "recording_id",
            *TL.violation(
                stage,
                F.when(F.col("__actual").isNull(), F.lit("missing_file")).otherwise(F.lit("hash_mismatch")),
                F.col("subject"),
                F.col("__actual"),
            ),
        )
    )
