import random

import pandas as pd
from pyspark.sql import functions as F

from songframe.operators import catalog as CT
from songframe.sources import catalog as SC

FIELDS = "track_id bigint, artist_id bigint, genre_top string, metadata_duration_seconds bigint, license string"


def test_csv_with_two_header_rows(spark, tmp_path):
    path = tmp_path / "tracks.csv"
    path.write_text(
        ",track,track,track,track,artist,artist,album,album\n"
        ",duration,genre_top,license,title,id,name,id,title\n"
        "track_id,,,,,,,,\n"
        '2,168.0, Rock ,CC0 1.0 Universal,"Food, more",1,AWOL,1,"Way ""One"""\n'
        "3,,Rock,CC0 1.0 Universal,x,1,AWOL,1,y\n"
        '1234567,300,Folk,CC0 1.0 Universal,"two\nlines",2,B,2,z\n'
        "5,300,,CC0 1.0 Universal,x,2,B,2,z\n"
        "6,300,Folk,Other,x,2,B,2,z\n"
        "7,601,Folk,CC0 1.0 Universal,x,2,B,2,z\n"
        "8,120.9,Folk,CC0 1.0 Universal,x,2,B,2,z\n"
    )
    assert SC.stacked_header(spark, str(path))[:4] == ["", "track.duration", "track.genre_top", "track.license"]
    tracks = SC.read_tracks_csv(spark, str(path))
    assert tracks.count() == 7
    rows = {r.track_id: r for r in CT.eligible_tracks(tracks).collect()}
    assert set(rows) == {2, 8, 1234567}
    assert rows[2].title == "Food, more" and rows[2].album == 'Way "One"' and rows[2].genre_top == "Rock"
    assert rows[2].archive_member == "fma_full/000/000002.mp3" and rows[8].metadata_duration_seconds == 120
    assert rows[1234567].archive_member == "fma_full/123/1234567.mp3"


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"track_id": 1, "genre_top": "Rock", "decoded_duration_seconds": null}, {"track_id": 2}]')
    rows = SC.read_catalog_manifest(spark, str(tmp_path / "m.json")).orderBy("track_id").collect()
    assert [r.track_id for r in rows] == [1, 2] and rows[0].decoded_duration_seconds is None


def random_catalog(rng, tracks, genres, artists):
    return [(i, rng.randint(0, artists - 1), f"g{rng.randint(0, genres - 1):02d}", 200, "L") for i in range(tracks)]


def test_pruned_draw_equals_the_draw_over_everything(spark):
    rng = random.Random(11)
    for tracks, genres, artists, count in ((300, 4, 6, 12), (300, 3, 2, 9), (200, 30, 40, 10), (60, 5, 60, 25)):
        rows = random_catalog(rng, tracks, genres, artists)
        df = spark.createDataFrame(rows, FIELDS)
        got = [r.track_id for r in CT.select_diverse(df, count, 3).orderBy("selection_order").collect()]
        pool = df.withColumn("draw", CT.draw_key(3)).toPandas()
        # The rule, written out over the whole catalog.
        left = {g: p.sort_values("draw")[["track_id", "artist_id"]].values.tolist() for g, p in pool.groupby("genre_top")}
        want, seen = [], set()
        while len(want) < count and any(left.values()):
            for genre in sorted(left):
                if left[genre] and len(want) < count:
                    pick = ([t for t in left[genre] if t[1] not in seen] or left[genre])[0]
                    left[genre].remove(pick)
                    want.append(pick[0])
                    seen.add(pick[1])
        assert got == want


def test_too_small_a_catalog(spark):
    df = spark.createDataFrame(random_catalog(random.Random(1), 7, 2, 3), FIELDS)
    chosen = CT.select_diverse(df, 10, 1)
    assert chosen.count() == 7
    assert [r.detail for r in CT.shortfall(chosen, 10).collect()] == ["7"]
    assert CT.shortfall(chosen, 7).count() == 0


def test_rank_draw_prefers_unseen_artists(spark):
    df = spark.createDataFrame(random_catalog(random.Random(2), 400, 3, 12), FIELDS)
    drawn = CT.draw_by_rank(df, 9, 5).toPandas()
    assert len(drawn) == 9 and drawn["genre_rank"].max() == 3
    assert isinstance(drawn, pd.DataFrame) and (drawn["is_repeat"] == 0).all()


def test_only_archived_tracks(spark):
    df = CT.eligible_tracks(spark.createDataFrame([(1, 1, "g", 200, "CC0 1.0 Universal"), (2, 1, "g", 200, "CC0 1.0 Universal")], FIELDS))
    members = spark.createDataFrame([("fma_full/000/000002.mp3",)], "archive_member string")
    assert [r.track_id for r in CT.in_archive(df, members).select(F.col("track_id")).collect()] == [2]
