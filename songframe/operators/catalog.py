"""Catalog eligibility and genre-diverse selection."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songframe.functions import exprs as X

# Fixed values written next to every selected track.
LICENSE_URL = "https://creativecommons.org/publicdomain/zero/1.0/"
DATASET_URL = "https://github.com/mdeff/fma"
ARCHIVE_PREFIX = "fma_full"
DEFAULT_SEED = 20260812
DEFAULT_COUNT = 25


def eligible_tracks(
    tracks: DataFrame, min_seconds: int = 120, max_seconds: int = 600, license_name: str = X.LICENSE
) -> DataFrame:
    """Tracks with the wanted license, a genre and a length in range, with derived columns."""
    identifier = F.format_string("%06d", F.col("track_id"))
    return (
        tracks.withColumn("genre_top", X.stripped("genre_top"))
        .withColumn("license", X.stripped("license"))
        .filter(
            (F.col("license") == license_name)
            & (F.col("genre_top") != "")
            & F.col("metadata_duration_seconds").between(min_seconds, max_seconds)
        )
        .withColumn("license_url", F.lit(LICENSE_URL))
        .withColumn("dataset_url", F.lit(DATASET_URL))
        .withColumn(
            "archive_member",
            F.concat(F.lit(ARCHIVE_PREFIX + "/"), F.substring(identifier, 1, 3), F.lit("/"), identifier, F.lit(".mp3")),
        )
    )


def in_archive(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates whose file is listed in the archive."""
    return candidates.join(members.select("archive_member"), "archive_member", "left_semi")


def draw_key(seed: int, track_id: str = "track_id"):
    """Seeded order that every engine with SHA-256 can reproduce."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(track_id).cast("string")), 256)


def _first_of_artist(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The first-drawn track of each group, found with a partial minimum per group."""
    return candidates.groupBy(*keys).agg(F.min(F.struct("draw", "track_id")).alias("__first")).select(
        F.col("__first.track_id").alias("track_id")
    )


def draw_by_rank(candidates: DataFrame, count: int = DEFAULT_COUNT, seed: int = DEFAULT_SEED) -> DataFrame:
    """Round-robin over genres, each genre listing first tracks of unseen artists first.

    Artist repetition is judged on the whole catalog beforehand, so this form is declarative but
    may repeat an artist across genres; ``select_diverse`` is the exact form. Repeats are flagged
    through the unique track id, and the per-genre rank is cut to ``count`` before the shuffle
    (window group limit), so neither a hot artist nor a hot genre gathers in one task.
    """
    drawn = candidates.withColumn("draw", draw_key(seed))
    first = _first_of_artist(drawn, ["artist_id"]).withColumn("__new", F.lit(0))
    flagged = drawn.join(first, "track_id", "left").withColumn(
        "is_repeat", F.coalesce("__new", F.lit(1))
    ).drop("__new")
    by_genre = Window.partitionBy("genre_top").orderBy("is_repeat", "draw")
    ranked = flagged.withColumn("genre_rank", F.row_number().over(by_genre)).filter(
        F.col("genre_rank") <= count
    )
    return ranked.orderBy("genre_rank", "genre_top").limit(count)


def _round_robin(pool: pd.DataFrame, count: int) -> pd.DataFrame:
    """Visit genres in name order, one track per visit, preferring artists not yet chosen."""
    queues = {
        genre: deque(group.sort_values("draw").index) for genre, group in pool.groupby("genre_top", sort=True)
    }
    artist = pool["artist_id"].to_dict()
    chosen: list[int] = []
    seen: set = set()
    while len(chosen) < count and any(queues.values()):
        for queue in queues.values():
            if not queue or len(chosen) == count:
                continue
            pick = next((row for row in queue if artist[row] not in seen), queue[0])
            queue.remove(pick)
            chosen.append(pick)
            seen.add(artist[pick])
    result = pool.loc[chosen].copy()
    result["selection_order"] = range(len(chosen))
    return result


def prune_for_draw(candidates: DataFrame, count: int, seed: int) -> DataFrame:
    """The only tracks an exact draw of ``count`` can reach.

    A visit to a genre always yields a track, so no genre after the first ``count`` in name order
    is ever visited. Each remaining genre keeps its first 2*count tracks and the first track of each of its first 2*count
    artists. Both cuts are window group limits over rows already reduced by partial aggregates.
    The result has at most 4*count rows per genre, 4*count*count in all.
    """
    visited = candidates.select("genre_top").distinct().orderBy("genre_top").limit(count)
    drawn = candidates.join(F.broadcast(visited), "genre_top", "left_semi").withColumn(
        "draw", draw_key(seed)
    )
    keep = 2 * count
    by_genre = Window.partitionBy("genre_top").orderBy("draw")

    def leading(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__n", F.row_number().over(by_genre)).filter(F.col("__n") <= keep).drop("__n")

    own = ["track_id", "genre_top", "artist_id", "draw"]
    openers = drawn.groupBy("genre_top", "artist_id").agg(
        F.min(F.struct("draw", "track_id")).alias("__first")
    ).select(F.col("__first.track_id").alias("track_id"), "genre_top", "artist_id", F.col("__first.draw").alias("draw"))
    return leading(drawn.select(*own)).unionByName(leading(openers)).distinct()


def select_diverse(
    candidates: DataFrame, count: int = DEFAULT_COUNT, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Exactly the greedy draw: round-robin over genres with one artist memory for all of them.

    The draw is sequential, so the catalog is first reduced to the rows it can reach (at most
    4*count*count) and only those meet in one group.
    """
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    schema = (
        f"track_id {types['track_id']}, genre_top string, artist_id {types['artist_id']}, "
        "draw string, selection_order bigint"
    )

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        return _round_robin(pool.reset_index(drop=True), count)[
            ["track_id", "genre_top", "artist_id", "draw", "selection_order"]
        ]

    picked = (
        prune_for_draw(candidates, count, seed)
        .withColumn("__all", F.lit(0))
        .groupBy("__all")
        .applyInPandas(fold, schema)
    )
    # The picks are ``count`` rows, whatever the catalog's size.
    return candidates.join(
        F.broadcast(picked.select("track_id", "selection_order")), "track_id"
    )


def shortfall(selected: DataFrame, count: int) -> DataFrame:
    """One violation when fewer than ``count`` tracks could be chosen."""
    return selected.agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") < count).select(
        F.lit("catalog").alias("recording_id"),
        F.lit("catalog").alias("stage"),
        F.lit("too_few_tracks").alias("check"),
        F.lit("selection").alias("subject"),
        F.lit("error").alias("severity"),
        F.col("found").cast("string").alias("detail"),
    )
