"""CSV readers: explicit schemas, bad numbers become null, blank texts become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = (
    "row_index int, track_id string, artists string, album_name string, track_name string, popularity int, duration_ms int, explicit boolean, danceability double, energy double, key int, "
    "loudness double, mode int, speechiness double, acousticness double, instrumentalness double, liveness double, valence double, tempo double, time_signature int, track_genre string"
)
PLAYLIST = "user_id string, artist string, track string, playlist string"


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A missing flag counts as false."""
    rows = spark.read.csv(path, schema=CATALOG, header=True, mode="PERMISSIVE", enforceSchema=True, quote='"', escape='"')
    return _blank_to_null(rows).withColumn("explicit", F.coalesce("explicit", F.lit(False)))


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _blank_to_null(spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", quote='"', escape='"'))


def placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a file scan with the place of each in its files: path, start of the block, order within the block.

    The places sort as the rows stand in the files, whatever their number, size or splits: a block's rows are read by one
    task, one after the other, so an id that grows within a task orders them.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(name))


def read_playlists(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """Columns by position, backslash escapes; rows without user or playlist are dropped. ``place``: a column for ``placed``."""
    rows = spark.read.csv(path, schema=PLAYLIST, header=True, mode="PERMISSIVE", enforceSchema=True, quote='"', escape="\\", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return _blank_to_null(placed(rows, place) if place else rows).where("user_id IS NOT NULL AND playlist IS NOT NULL")
