"""The catalogue as the driver's tables can play it. Nulls, imputed marks and empty lists come from fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(factor: int, modulus: int, scale: float):
    return (F.col("p_partkey") * factor % modulus).cast("double") / scale


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("p_partkey")
    features = F.struct(
        _part(7, 101, 100.0).alias("Danceability"),
        F.when(id_ % 19 != 0, _part(13, 97, 96.0)).alias("Energy"),
        _part(29, 89, 88.0).alias("Valence"),
        (F.col("p_size") * 2 + 60).cast("double").alias("Tempo"),
        _part(31, 83, 82.0).alias("Acousticness"),
        _part(37, 79, 78.0).alias("Instrumentalness"),
        _part(41, 73, 72.0).alias("Liveness"),
        _part(43, 71, 70.0).alias("Speechiness"),
        (-_part(47, 67, 2.0)).alias("Loudness"),
        (id_ % 12).cast("int").alias("Key"),
        (id_ % 2).cast("int").alias("Mode"),
        (id_ % 3 + 3).cast("int").alias("TimeSignature"),
        F.when(id_ % 11 != 0, F.lower("p_type")).alias("Genre"),
        F.when(id_ % 7 != 1, id_ % 7 == 0).alias("IsImputed"),
    )
    person = lambda name: F.struct(name.alias("Id"), name.alias("Name"))
    credits = F.array(person(F.col("p_brand")), person(F.concat(F.lit("Maker "), (id_ % 23).cast("string"))))
    return table(spark, sf_dir, "part").select(
        id_.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("popularity"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("duration_ms"),
        (id_ % 97).alias("album_id"),
        F.when(id_ % 13 == 0, F.slice(credits, 1, 0)).otherwise(credits).alias("artists"),
        F.when(id_ % 17 != 0, features).alias("audio_features"),
    )


#: The same in SQL, flat: a column for each field of the features.
TRACKS_SQL = """tracks AS (SELECT p_partkey AS id, p_name AS name, p_size AS popularity, CAST(round(p_retailprice * 100) AS BIGINT) AS duration_ms, p_partkey % 97 AS album_id,
  CASE WHEN p_partkey % 13 = 0 THEN [] ELSE [p_brand, 'Maker ' || (p_partkey % 23)] END AS artists, p_partkey % 17 <> 0 AS has_features,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 7 % 101) / 100e0 END AS danceability, CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 THEN (p_partkey * 13 % 97) / 96e0 END AS energy,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 29 % 89) / 88e0 END AS valence, CASE WHEN p_partkey % 17 <> 0 THEN CAST(60 + p_size * 2 AS DOUBLE) END AS tempo,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 31 % 83) / 82e0 END AS acousticness, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 37 % 79) / 78e0 END AS instrumentalness,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 41 % 73) / 72e0 END AS liveness, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 43 % 71) / 70e0 END AS speechiness,
  CASE WHEN p_partkey % 17 <> 0 THEN -(p_partkey * 47 % 67) / 2e0 END AS loudness, CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey % 12 AS INTEGER) END AS key,
  CASE WHEN p_partkey % 17 <> 0 AND p_partkey % 11 <> 0 THEN lower(p_type) END AS genre, p_partkey % 17 <> 0 AND p_partkey % 7 = 0 AS is_imputed FROM part)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays: each line item is a track on an album (its order)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return items.join(part, items.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("track_id"), F.when(F.col("l_partkey") % 11 != 0, F.lower("p_type")).alias("genre"), F.col("l_quantity").alias("popularity"), (F.col("l_partkey") % 7 == 0).alias("is_imputed")
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 37 % 101).cast("int").alias("popularity"), F.floor(F.abs("s_acctbal")).cast("long").alias("followers"), (F.col("s_suppkey") % 5 != 0).alias("is_enriched")
    )


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; some have no year."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("album_id"), F.concat(F.lit("Album "), F.col("o_orderkey").cast("string")).alias("album_name"), F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("release_year")
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


DIMS = 64


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a genre (some without), provenance, popularity and the key of their work."""
    id_ = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        id_.alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(id_ % 10 != 7, F.concat(F.lit("g"), F.col("label").cast("string"))).alias("genre"),
        (id_ % 6 == 5).alias("is_imputed"),
        (id_ * 31 % 101).alias("popularity"),
        F.concat(F.lit("work "), F.floor(id_ / 3).cast("string")).alias("key"),
    )


ITEMS_SQL = """items AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector, CASE WHEN vec_id % 10 <> 7 THEN 'g' || label END AS genre, vec_id % 6 = 5 AS is_imputed,
  vec_id * 31 % 101 AS popularity, 'work ' || (vec_id // 3) AS key FROM embeddings),
dims AS (SELECT id, unnest(vector) AS v, unnest(range(1, 65)) AS k FROM items),
params AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-9 THEN 1.0 ELSE stddev_pop(v) END AS d FROM dims GROUP BY k),
idx AS (SELECT id, list((v - m) / d ORDER BY k) AS unit FROM dims JOIN params USING (k) GROUP BY id),
facts AS (SELECT items.*, unit FROM items JOIN idx USING (id)),
pairs AS (SELECT s.id AS seed_id, c.id AS id, s.genre AS seed_genre, s.is_imputed AS seed_imputed, c.genre, c.is_imputed, c.popularity, c.key,
  round(list_cosine_similarity(c.unit, s.unit), 9) AS cosine, s.unit AS seed_unit, c.unit AS unit FROM facts s JOIN facts c ON s.id <> c.id WHERE s.id % 100 = 0)"""


def seeds(index: DataFrame) -> DataFrame:
    """The searches' queries: ids divisible by 100."""
    return index.where(F.col("id") % 100 == 0)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        id_.alias("id"), F.col("ts").alias("occurred_at"), F.col("event_type"), F.when(id_ % 3 == 0, F.col("ts")).alias("processed_at"), (id_ % 5).cast("int").alias("attempts"), F.when(id_ % 20 == 7, F.col("ts")).alias("dead_lettered_at")
    )
