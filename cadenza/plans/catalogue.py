"""Read models, scans, look-ups, co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.numeric import clamp
from cadenza.functions.text import duration_label, truncated
from cadenza.operators import cooccurrence as co
from cadenza.operators import dataset, insights, matching, paging
from cadenza.operators.insights import MEASURES, complete
from cadenza.plans.registry import query
from cadenza.plans.views import TRACKS_SQL, albums, artists, baskets, lines, table, tracks

T = f"WITH {TRACKS_SQL} "
LINES = "lines AS (SELECT l_orderkey AS album_id, l_partkey AS track_id, CASE WHEN l_partkey % 11 <> 0 THEN lower(p_type) END AS genre, l_quantity AS popularity, l_partkey % 7 = 0 AS is_imputed FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {LINES} SELECT coalesce(genre, '(no genre)') AS genre, round(avg(popularity), 6) AS average_popularity, round(quantile_cont(popularity, 0.5), 6) AS median_popularity,
 count(*) AS track_count, count(*) FILTER (is_imputed) AS imputed_track_count FROM lines GROUP BY 1 ORDER BY average_popularity DESC, genre LIMIT 20""")
def genre_insights(spark, d):
    return insights.genre_insights(lines(spark, d))


@query(f"""WITH {LINES} SELECT coalesce(genre, '(no genre)') AS genre, round(avg(popularity), 6) AS average_popularity, round(quantile_cont(popularity, 0.5), 6) AS median_popularity,
 count(*) AS track_count, count(*) FILTER (is_imputed) AS imputed_track_count FROM lines GROUP BY 1 ORDER BY track_count DESC, genre LIMIT 3 OFFSET 3""")
def genre_insights_sorted(spark, d):
    return insights.genre_insights(lines(spark, d), "count", page=2, size=3)


@query("""SELECT * FROM (SELECT l_orderkey AS album_id, round(avg(l_quantity), 6) AS average_popularity, count(*) AS track_count FROM lineitem GROUP BY 1 ORDER BY average_popularity DESC, album_id LIMIT 50)
 LEFT JOIN (SELECT o_orderkey AS album_id, 'Album ' || o_orderkey AS album_name FROM orders) USING (album_id)""")
def album_insights(spark, d):
    plays = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.col("l_quantity").alias("popularity"))
    return insights.album_insights(plays, albums(spark, d), size=50)


@query("""SELECT * FROM (SELECT l_orderkey AS album_id, round(avg(l_quantity), 6) AS average_popularity, count(*) AS track_count FROM lineitem GROUP BY 1 ORDER BY track_count DESC, album_id LIMIT 20)
 LEFT JOIN (SELECT o_orderkey AS album_id, 'Album ' || o_orderkey AS album_name FROM orders) USING (album_id)""")
def album_insights_sorted(spark, d):
    plays = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.col("l_quantity").alias("popularity"))
    return insights.album_insights(plays, albums(spark, d), "count")


@query("""SELECT CASE WHEN o_orderkey % 9 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, round(avg(l_quantity), 6) AS average_popularity, count(*) AS track_count, count(DISTINCT l_orderkey) AS album_count
 FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY year DESC NULLS LAST LIMIT 20""")
def year_insights(spark, d):
    plays = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.col("l_quantity").alias("popularity"))
    return insights.year_insights(plays, albums(spark, d))


@query("""SELECT s_suppkey AS artist_id, s_name AS name, CAST(s_suppkey * 37 % 101 AS INTEGER) AS popularity, CAST(floor(abs(s_acctbal)) AS BIGINT) AS followers, true AS is_enriched,
 (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0) AS total_count FROM supplier WHERE s_suppkey % 5 <> 0 ORDER BY popularity DESC, artist_id LIMIT 20""")
def artist_listing(spark, d):
    return insights.artist_listing(artists(spark, d))


@query("""SELECT s_suppkey AS artist_id, s_name AS name, CAST(s_suppkey * 37 % 101 AS INTEGER) AS popularity, CAST(floor(abs(s_acctbal)) AS BIGINT) AS followers, s_suppkey % 5 <> 0 AS is_enriched,
 (SELECT count(*) FROM supplier) AS total_count FROM supplier ORDER BY followers DESC, artist_id LIMIT 10 OFFSET 10""")
def artist_listing_sorted(spark, d):
    return insights.artist_listing(artists(spark, d), True, "followers", page=2, size=10)


@query(T + """SELECT count(*) AS total_tracks, count(*) FILTER (has_features) AS tracks_with_audio_features, count(*) FILTER (NOT has_features) AS tracks_without_audio_features,
 count(*) FILTER (has_features AND NOT is_imputed) AS tracks_with_measured_features, count(*) FILTER (has_features AND is_imputed) AS tracks_with_imputed_features, count(DISTINCT genre) AS distinct_genres,
 (SELECT count(*) FROM supplier) AS distinct_artists, (SELECT count(*) FROM orders) AS distinct_albums FROM tracks""")
def catalog_summary(spark, d):
    return insights.catalog_summary(tracks(spark, d), artists(spark, d), albums(spark, d))


RANKED = "SELECT id, name, popularity, genre, artists[1] AS artist_name"


@query(T + RANKED + " FROM tracks ORDER BY popularity DESC, id LIMIT 20")
def rank_top(spark, d):
    return insights.ranking(tracks(spark, d))


@query(T + RANKED + " FROM tracks WHERE genre = 'promo' ORDER BY popularity DESC, id LIMIT 20")
def rank_top_filtered(spark, d):
    return insights.ranking(tracks(spark, d), "  PROMO ")


@query(T + RANKED + ", (SELECT count(*) FROM tracks) AS total_count FROM tracks ORDER BY popularity DESC, id LIMIT 30 OFFSET 60")
def rank_top_paged(spark, d):
    return insights.ranking(tracks(spark, d), page=3, size=30, total=True)


@query("""WITH c AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_partkey % 7 <> 0), b AS (SELECT min(v) AS lo, max(v) AS hi FROM c),
t AS (SELECT least(CAST(floor(20 * (v - lo) / (hi - lo)) + 1 AS BIGINT), 20) AS bucket, count(*) AS n FROM c, b GROUP BY 1)
SELECT g AS bucket, round(lo + (g - 1) * ((hi - lo) / 20), 6) AS lower_bound, round(least(lo + g * ((hi - lo) / 20), hi), 6) AS upper_bound, coalesce(n, 0) AS count FROM b, range(1, 21) r(g) LEFT JOIN t ON t.bucket = g""")
def feature_histogram(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value"), (F.col("l_partkey") % 7 == 0).alias("flag"))
    return insights.histogram(rows, "value", "flag")


@query("""SELECT count(*) FILTER (l_partkey % 7 <> 0) AS measured_count, count(*) FILTER (l_partkey % 7 = 0) AS imputed_count, count(*) FILTER (l_partkey % 7 <> 0) AS total_considered,
 min(l_extendedprice) FILTER (l_partkey % 7 <> 0) AS min_value, max(l_extendedprice) FILTER (l_partkey % 7 <> 0) AS max_value FROM lineitem""")
def feature_histogram_meta(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value"), (F.col("l_partkey") % 7 == 0).alias("flag"))
    return insights.histogram_population(rows, "value", "flag", False)


@query("WITH l AS (SELECT l_quantity AS q, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, 3e0 AS constant, CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice END AS holes FROM lineitem), f AS ("
 + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS sample_size, corr({f}, q) AS r FROM l" for f in ("price", "discount", "tax", "constant", "holes"))
 + ") SELECT feature, sample_size, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS correlation FROM f")
def feature_correlations(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.lit(3.0).alias("constant"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_extendedprice")).alias("holes")
    )
    return insights.correlations(rows, ["price", "discount", "tax", "constant", "holes"], "q")


@query(T + "SELECT id, name, popularity, has_features AS has_audio_features FROM tracks WHERE name ILIKE '%re_%' ORDER BY popularity DESC, id LIMIT 20")
def search_ilike(spark, d):
    return insights.search(tracks(spark, d), "RE_", artists_too=False)


@query(T + "SELECT id, name, popularity, has_features AS has_audio_features FROM tracks WHERE name ILIKE '%maker 2%' OR len(list_filter(artists, lambda a: a ILIKE '%maker 2%')) > 0 ORDER BY popularity DESC, id LIMIT 200")
def search_array_exists(spark, d):
    return insights.search(tracks(spark, d), "maker 2", size=500)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    return paging.page_of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], page=3)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 200 + 1 AS page FROM orders")
def page_drain(spark, d):
    """All pages at once: one sort gives each row its page."""
    return paging.all_pages(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(T + "SELECT id, name, popularity FROM tracks WHERE id > 150 ORDER BY id LIMIT 100")
def scan_keyset_batch(spark, d):
    return paging.keyset_batch(tracks(spark, d).select("id", "name", "popularity"), "id", 150, 1)


@query(T + "SELECT id, name, popularity, genre, artists[1] AS artist_name, tempo FROM tracks WHERE id = 42")
def lookup_by_id(spark, d):
    return tracks(spark, d).where("id = 42").select("id", "name", "popularity", F.col("audio_features.Genre").alias("genre"), F.get("artists", F.lit(0))["Name"].alias("artist_name"), F.col("audio_features.Tempo").alias("tempo"))


@query(T + "SELECT id, name FROM tracks WHERE id IN (3, 13, 17, 150, 999999)")
def lookup_by_ids(spark, d):
    return tracks(spark, d).where(F.col("id").isin(3, 13, 17, 150, 999999)).select("id", "name")


@query(T + "SELECT id, name, album_name FROM tracks LEFT JOIN (SELECT o_orderkey AS album_id, 'Album ' || o_orderkey AS album_name FROM orders) USING (album_id)")
def metadata_decorate(spark, d):
    return tracks(spark, d).join(albums(spark, d), "album_id", "left").select("id", "name", "album_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_extract_cast(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query(T + "SELECT id, artists[1] AS artist_name FROM tracks")
def array_first_field(spark, d):
    return tracks(spark, d).select("id", F.get("artists", F.lit(0))["Name"].alias("artist_name"))


@query(T + "SELECT id, energy FROM tracks WHERE has_features AND NOT is_imputed")
def provenance_cut(spark, d):
    return insights.provenance_cut(tracks(spark, d).where("audio_features IS NOT NULL")).select("id", F.col("audio_features.Energy").alias("energy"))


@query(T + "SELECT id FROM tracks WHERE has_features AND energy IS NOT NULL")
def eligible_complete(spark, d):
    flat = tracks(spark, d).select("id", "audio_features.*")
    return flat.where(complete(list(MEASURES))).select("id")


@query("SELECT CASE WHEN l_partkey % 11 <> 0 THEN lower(p_type) END AS genre, count(*) AS n, count(*) FILTER (q = 0) AS zeros, round(100.0 * count(*) FILTER (q = 0) / count(*), 6) AS zero_percent, round(avg(q), 6) AS mean, round(quantile_cont(q, 0.5), 6) AS median, max(q) AS highest FROM (SELECT *, greatest(l_quantity - 10, 0) AS q FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1")
def zero_inflation(spark, d):
    return insights.zero_inflation(lines(spark, d).withColumn("popularity", F.greatest(F.col("popularity") - 10, F.lit(0.0))))


@query(T + "SELECT DISTINCT lower(genre) AS genre FROM tracks WHERE genre IS NOT NULL")
def distinct_ids(spark, d):
    return tracks(spark, d).select(F.lower("audio_features.Genre").alias("genre")).where("genre IS NOT NULL").distinct()


@query(T + "SELECT id, (duration_ms // 1000) // 60 || ':' || lpad(CAST(duration_ms // 1000 % 60 AS VARCHAR), 2, '0') AS label, round(popularity * 1e0 / (SELECT sum(popularity) FROM tracks), 9) AS share FROM tracks")
def fmt_duration_share(spark, d):
    rows = tracks(spark, d)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("popularity").alias("s")))).select("id", duration_label(F.col("duration_ms")).alias("label"), F.round(F.try_divide(F.col("popularity").cast("double"), "s"), 9).alias("share"))


@query("SELECT event_id, CASE WHEN isnan(x) THEN 0e0 ELSE least(100, greatest(0, x)) END AS value, isnan(x) OR x < 0 OR x > 100 AS clamped FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE ELSE value * 3 - 40 END AS x FROM events)")
def clamp_prediction(spark, d):
    x = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 3 - 40)
    value, outside = clamp(F.col("x"))
    return table(spark, d, "events").select("event_id", x.alias("x")).select("event_id", value.alias("value"), outside.alias("clamped"))


DISTINCT = "b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem)"
EDGES = DISTINCT + """, p AS (SELECT x.item AS low, y.item AS high, count(*) AS co_count FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT item, count(*) AS total FROM b GROUP BY 1),
e AS (SELECT low, high, co_count, l.total AS low_total, h.total AS high_total, round(co_count / (l.total + h.total - co_count), 9) AS jaccard FROM p JOIN t l ON l.item = low JOIN t h ON h.item = high)"""


@query(f"WITH {EDGES} SELECT low, high, co_count FROM p")
def cooccurrence_pairs(spark, d):
    return co.pairs(baskets(spark, d))


@query(f"WITH {EDGES} SELECT * FROM e")
def cooccurrence_jaccard(spark, d):
    return co.matrix(baskets(spark, d))


@query(f"WITH {EDGES} SELECT * FROM (SELECT low AS seed, high AS item, co_count, jaccard FROM e UNION ALL SELECT high, low, co_count, jaccard FROM e) WHERE seed % 100 = 0")
def cooccurring_of_seed(spark, d):
    return co.of_seeds(co.matrix(baskets(spark, d)), tracks(spark, d).where("id % 100 = 0").select(F.col("id").alias("seed")))


@query(f"WITH {EDGES} SELECT count(DISTINCT i) AS covered FROM (SELECT low AS i FROM e UNION ALL SELECT high FROM e)")
def cooccurrence_coverage(spark, d):
    return co.coverage(co.pairs(baskets(spark, d)))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topn_per_group(spark, d):
    return matching.top_of_each(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT c_custkey FROM customer ORDER BY md5('20260730' || c_custkey), c_custkey LIMIT 100")
def hash_sample(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.lit("20260730"), F.col("c_custkey").cast("string"))), "c_custkey").limit(100)


@query(T + "SELECT id, CASE WHEN trim(name) = '' THEN 'name' WHEN popularity > 40 THEN 'popularity' WHEN NOT has_features OR energy IS NULL THEN 'measures' END AS reason FROM tracks")
def load_validity(spark, d):
    flat = tracks(spark, d).select(F.col("id").cast("string").alias("id"), "name", F.when(F.col("popularity") <= 40, F.col("popularity")).otherwise(F.col("popularity") + 100).alias("popularity"), "duration_ms", "audio_features.*")
    return flat.select(F.col("id").cast("long").alias("id"), matching.validity(flat, list(MEASURES)).alias("reason"))



@query(T + "SELECT id, i - 1 AS position, artists[i] AS artist FROM (SELECT id, artists, unnest(range(1, len(artists) + 1)) AS i FROM tracks)")
def array_unnest(spark, d):
    """A row for each credit; tracks without credits have none."""
    return tracks(spark, d).select("id", F.posexplode("artists").alias("position", "credit")).select("id", F.col("position").cast("long").alias("position"), F.col("credit.Name").alias("artist"))


@query(T + """SELECT id, CASE WHEN danceability IS NULL OR danceability NOT BETWEEN 0 AND 1 THEN 'danceability' WHEN energy IS NULL OR energy NOT BETWEEN 0 AND 1 THEN 'energy' WHEN tempo - 100 < 0 OR tempo - 100 > 300 THEN 'tempo'
 WHEN loudness * 2 < -60 OR loudness * 2 > 5 THEN 'loudness' WHEN duration_ms NOT BETWEEN 1000 AND 7200000 THEN 'duration_ms' WHEN key NOT BETWEEN 0 AND 11 THEN 'key' END AS bad FROM tracks WHERE has_features""")
def input_ranges(spark, d):
    """The first feature of each track that lies outside the range allowed for ad-hoc input (tempo and loudness stretched)."""
    f = tracks(spark, d).where("audio_features IS NOT NULL").select("id", "duration_ms", "audio_features.*")
    named = f.select("id", F.col("Danceability").alias("danceability"), F.col("Energy").alias("energy"), (F.col("Tempo") - 100).alias("tempo"), (F.col("Loudness") * 2).alias("loudness"), "duration_ms", F.col("Key").alias("key"))
    return named.select("id", dataset.first_out_of_range(["danceability", "energy", "tempo", "loudness", "duration_ms", "key"]).alias("bad"))


@query("SELECT doc_id, left(text, 400) AS text FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", truncated(F.col("text")).alias("text"))
