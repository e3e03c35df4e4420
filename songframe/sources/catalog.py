"""Track catalogs: the two-header CSV and the JSON manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songframe import schemas

# Where the catalog columns come from in the CSV's group.field header.
CSV_FIELDS = {
    "title": "track.title",
    "artist": "artist.name",
    "album": "album.title",
    "genre_top": "track.genre_top",
    "license": "track.license",
}
CSV_NUMBERS = {"artist_id": "artist.id", "album_id": "album.id"}
CSV_DURATION = "track.duration"


def stacked_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV whose first two rows hold group and field.

    Only the first two lines are read.
    """
    lines = [r.value for r in spark.read.text(path).limit(2).collect()]
    parsed = spark.createDataFrame([(line,) for line in lines], "value string")
    width = max(line.count(",") for line in lines) + 1
    names = [f"c{i}" for i in range(width)]
    row_schema = ", ".join(f"{n} string" for n in names)
    top, below = [
        [r[0][n] or "" for n in names]
        for r in parsed.select(F.from_csv("value", row_schema)).collect()
    ]
    return [f"{group}.{field}" if group else field for group, field in zip(top, below)]


def read_tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalog columns of every track row; header rows are those without a numeric id.

    Quoted fields may span lines, so the file is split by the CSV reader and not by line.
    """
    header = stacked_header(spark, path)
    position = {name: i for i, name in enumerate(header)}
    columns = [f"c{i}" for i in range(len(header))]
    raw = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    at = lambda name: F.col(columns[position[name]])
    seconds = F.coalesce(at(CSV_DURATION).try_cast("double"), F.lit(0.0)).try_cast("bigint")
    return raw.filter(F.col("c0").rlike(r"\A\d+\z")).select(
        F.col("c0").cast("bigint").alias("track_id"),
        *[F.coalesce(at(source), F.lit("")).alias(name) for name, source in CSV_FIELDS.items()],
        *[at(source).try_cast("bigint").alias(name) for name, source in CSV_NUMBERS.items()],
        seconds.alias("metadata_duration_seconds"),
    )


def read_catalog_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of catalog records."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", "true").json(path)
