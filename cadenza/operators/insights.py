"""Read models over a catalogue: grouped means and medians, histograms, correlations, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numeric import pearson
from cadenza.operators import ranks
from cadenza.operators.paging import DEFAULT_SIZE, page_of, sort_columns

NO_GENRE = "(no genre)"
MEASURES = ("Danceability", "Energy", "Valence", "Tempo", "Acousticness", "Instrumentalness", "Liveness", "Speechiness", "Loudness")


def is_imputed(features: str = "audio_features") -> Column:
    return F.coalesce(F.col(f"{features}.IsImputed"), F.lit(False))


def provenance_cut(df: DataFrame, include_imputed: bool = False, flag: Column | None = None) -> DataFrame:
    flag = is_imputed() if flag is None else flag
    return df if include_imputed else df.where(~flag)


def optional_equal(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """A blank or missing value filters nothing; others are compared trimmed and in lower case."""
    wanted = (wanted or "").strip().lower()
    return df.where(F.col(column) == wanted) if wanted else df


def genre_insights(df: DataFrame, sort: str = "average", page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """``df``: genre, popularity, is_imputed."""
    named = df.withColumn("genre", F.coalesce("genre", F.lit(NO_GENRE)))
    grouped = named.groupBy("genre").agg(F.round(F.avg("popularity"), 6).alias("average_popularity"), F.count("*").alias("track_count"), F.count_if("is_imputed").alias("imputed_track_count"))
    grouped = grouped.join(ranks.medians(named, ["genre"], "popularity"), "genre").select("genre", "average_popularity", F.round("median", 6).alias("median_popularity"), "track_count", "imputed_track_count")
    sorts = {"average": [F.desc("average_popularity"), F.asc("genre")], "count": [F.desc("track_count"), F.asc("genre")], "genre": [F.asc("genre")]}
    return page_of(grouped, sort_columns(sorts, sort), page, size)


def album_insights(tracks: DataFrame, albums: DataFrame, sort: str = "average", page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """``tracks``: album_id, popularity; ``albums``: album_id, album_name. Aggregated first, then decorated."""
    grouped = tracks.where(F.col("album_id").isNotNull()).groupBy("album_id").agg(F.round(F.avg("popularity"), 6).alias("average_popularity"), F.count("*").alias("track_count"))
    sorts = {"average": [F.desc("average_popularity"), F.asc("album_id")], "count": [F.desc("track_count"), F.asc("album_id")]}
    best = page_of(grouped, sort_columns(sorts, sort), page, size)  # names are joined to one page only
    return best.join(albums.select("album_id", "album_name"), "album_id", "left")


def year_insights(tracks: DataFrame, albums: DataFrame, sort: str = "year_desc", page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """Tracks without an album, or whose album has no year, make a group of their own, always last by year."""
    per_album = tracks.groupBy("album_id").agg(F.sum("popularity").alias("s"), F.count("popularity").alias("k"), F.count("*").alias("n"))
    joined = per_album.join(albums.select("album_id", "release_year"), "album_id", "left")
    grouped = joined.groupBy(F.col("release_year").alias("year")).agg(
        F.round(F.try_divide(F.sum("s"), F.sum("k")), 6).alias("average_popularity"), F.sum("n").alias("track_count"), F.count("album_id").alias("album_count")
    )
    sorts = {"average": [F.desc("average_popularity"), F.asc_nulls_last("year")], "year_asc": [F.asc_nulls_last("year")], "year_desc": [F.desc_nulls_last("year")]}
    return page_of(grouped, sort_columns(sorts, sort), page, size)


def artist_listing(artists: DataFrame, include_unenriched: bool = False, sort: str = "popularity", page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    rows = artists if include_unenriched else artists.where("is_enriched")
    sorts = {"popularity": [F.desc("popularity"), F.asc("artist_id")], "followers": [F.desc("followers"), F.asc("artist_id")], "name": [F.asc("name"), F.asc("artist_id")]}
    return page_of(rows, sort_columns(sorts, sort), page, size, total="total_count")


def catalog_summary(tracks: DataFrame, artists: DataFrame, albums: DataFrame) -> DataFrame:
    """One pass over each table."""
    has = F.col("audio_features").isNotNull()
    own = tracks.agg(
        F.count("*").alias("total_tracks"),
        F.count_if(has).alias("tracks_with_audio_features"),
        F.count_if(~has).alias("tracks_without_audio_features"),
        F.count_if(has & ~is_imputed()).alias("tracks_with_measured_features"),
        F.count_if(has & is_imputed()).alias("tracks_with_imputed_features"),
        F.countDistinct("audio_features.Genre").alias("distinct_genres"),
    )
    return own.crossJoin(F.broadcast(artists.agg(F.count("*").alias("distinct_artists")))).crossJoin(F.broadcast(albums.agg(F.count("*").alias("distinct_albums"))))


def ranking(tracks: DataFrame, genre: str | None = None, page: int = 1, size: int = DEFAULT_SIZE, total: bool = False) -> DataFrame:
    """Tracks by popularity with the first credited artist; ``total`` is true even past the last page."""
    rows = optional_equal(tracks.withColumn("genre", F.col("audio_features.Genre")), "genre", genre)
    rows = rows.select("id", "name", "popularity", "genre", F.get("artists", F.lit(0))["Name"].alias("artist_name"))
    return page_of(rows, [F.desc("popularity"), F.asc("id")], page, size, total="total_count" if total else None)


def histogram_population(df: DataFrame, value: str, flag: str, include_imputed: bool) -> DataFrame:
    """Measured, imputed and considered counts, and the considered range."""
    considered = F.lit(include_imputed) | ~F.col(flag)
    return df.where(F.col(value).isNotNull()).agg(
        F.count_if(~F.col(flag)).alias("measured_count"),
        F.count_if(flag).alias("imputed_count"),
        F.count_if(considered).alias("total_considered"),
        F.min(F.when(considered, F.col(value))).alias("min_value"),
        F.max(F.when(considered, F.col(value))).alias("max_value"),
    )


def histogram(df: DataFrame, value: str, flag: str, include_imputed: bool = False, buckets: int = 20) -> DataFrame:
    """Dense buckets of equal width; the greatest value falls into the last; a constant makes one bucket of width 1."""
    buckets = min(max(buckets, 1), 200)
    rows = provenance_cut(df.where(F.col(value).isNotNull()), include_imputed, F.col(flag)).select(F.col(value).cast("double").alias("value"))
    bounds = rows.agg(F.min("value").alias("low"), F.max("value").alias("top"))
    sized = bounds.where("low IS NOT NULL").select(
        "low", "top", F.when(F.col("top") > F.col("low"), buckets).otherwise(1).alias("n"), F.when(F.col("top") > F.col("low"), F.col("top")).otherwise(F.col("low") + 1).alias("high")
    )
    placed = rows.crossJoin(F.broadcast(sized)).select(F.least(F.width_bucket("value", "low", "high", "n"), F.col("n").cast("long")).alias("bucket"))
    tallies = placed.groupBy("bucket").agg(F.count("*").alias("tally"))
    width = (F.col("high") - F.col("low")) / F.col("n")
    dense = sized.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("bucket"))
    return dense.join(tallies, "bucket", "left").select(
        "bucket",
        F.round(F.col("low") + (F.col("bucket") - 1) * width, 6).alias("lower_bound"),
        F.round(F.least(F.col("low") + F.col("bucket") * width, F.col("top")), 6).alias("upper_bound"),
        F.coalesce("tally", F.lit(0).cast("long")).alias("count"),
    )


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """A row for each feature: pairs and correlation with the target; one pass, then turned."""
    row = df.agg(*(F.struct(F.count(F.when(F.col(f).isNotNull() & F.col(target).isNotNull(), 1)).alias("n"), F.round(pearson(F.col(f).cast("double"), F.col(target).cast("double")), 6).alias("r")).alias(f) for f in features))
    turned = row.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f)["n"].alias("sample_size"), F.col(f)["r"].alias("correlation")) for f in features))).alias("x"))
    return turned.select("x.*")


def search(tracks: DataFrame, term: str | None, page: int = 1, size: int = DEFAULT_SIZE, artists_too: bool = True) -> DataFrame:
    """Title, or any credited artist, contains the term whatever the case; % and _ in it stay wild; blank: all tracks."""
    rows = tracks
    if term and term.strip():
        pattern = f"%{term.strip()}%"
        hit = F.col("name").ilike(pattern)
        if artists_too:
            hit = hit | F.exists("artists", lambda a: a["Name"].ilike(pattern))
        rows = rows.where(hit)
    shown = rows.select("id", "name", "popularity", F.col("audio_features").isNotNull().alias("has_audio_features"))
    return page_of(shown, [F.desc("popularity"), F.asc("id")], page, size)


def zero_inflation(df: DataFrame) -> DataFrame:
    """``df``: genre, popularity. Rows without a genre are a group of their own."""
    flagged = df.select(F.col("genre").isNull().alias("bare"), F.coalesce("genre", F.lit("")).alias("genre"), "popularity")
    counts = flagged.groupBy("bare", "genre").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("popularity") == 0).alias("zeros"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("popularity") == 0), F.count("*")), 6).alias("zero_percent"),
        F.round(F.avg("popularity"), 6).alias("mean"),
        F.max("popularity").alias("highest"),
    )
    whole = counts.join(ranks.medians(flagged, ["bare", "genre"], "popularity"), ["bare", "genre"])
    return whole.select(F.when(~F.col("bare"), F.col("genre")).alias("genre"), "n", "zeros", "zero_percent", "mean", F.round("median", 6).alias("median"), "highest")


def complete(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
