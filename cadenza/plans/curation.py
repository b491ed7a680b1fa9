"""Matching, imputation, loading, training sets, event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import dataset, matching
from cadenza.operators.insights import MEASURES, complete
from cadenza.plans.catalogue import T
from cadenza.plans.registry import query
from cadenza.plans.views import TRACKS_SQL, events_log, table, tracks
from cadenza.sources import sinks
from cadenza.streaming import outbox

TITLE = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' - Remastered' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' (Live [x] take)' WHEN 3 THEN 'Coração ''' || p_name WHEN 4 THEN '  ' || p_name || '!!' ELSE p_name END"
CREDIT = "CASE WHEN p_partkey % 5 = 0 THEN ' ; ' || p_brand || ';Someone' ELSE p_brand || ';Other;other; ' END"


def titled(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(TITLE).alias("title"), F.expr(CREDIT).alias("credits"), F.round(F.col("p_retailprice") * 100).cast("long").alias("duration_ms"), "p_brand", "p_name")


#: Title cut, brackets (nested once) dropped, accents and apostrophes dropped, the rest single-spaced.
def key_sql(column: str) -> str:
    bare = f"regexp_replace(regexp_replace({column}, '\\[[^\\]]*\\]', ' ', 'g'), '\\([^)]*\\)', ' ', 'g')"
    return f"trim(regexp_replace(replace(lower(strip_accents({bare})), '''', ''), '[^a-z0-9]+', ' ', 'g'))"


MATCH_SQL = f"""titled AS (SELECT p_partkey AS id, {TITLE} AS title, {CREDIT} AS credits, CAST(round(p_retailprice * 100) AS BIGINT) AS duration_ms FROM part),
keyed AS (SELECT id, duration_ms, {key_sql("list_filter(list_transform(string_split(credits, ';'), lambda x: trim(x)), lambda x: x <> '')[1]")} || '|' ||
  {key_sql("CASE WHEN instr(title, ' - ') > 1 THEN substr(title, 1, instr(title, ' - ') - 1) ELSE title END")} AS match_key FROM titled)"""


@query(f"WITH {MATCH_SQL} SELECT id, match_key FROM keyed")
def match_key(spark, d):
    return titled(spark, d).select("id", text.match_key(F.col("title"), F.col("credits")).alias("match_key"))


@query(f"SELECT p_partkey AS id, list_filter(list_transform(string_split({CREDIT}, ';'), lambda x: trim(x)), lambda x: x <> '')[1] AS artist FROM part")
def split_primary(spark, d):
    return titled(spark, d).select("id", text.split_primary(F.col("credits")).alias("artist"))


@query(f"SELECT p_partkey AS id, CAST(0 AS INTEGER) AS position, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_brand END AS artist FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 5 = 0 THEN 'Someone' ELSE 'Other' END FROM part")
def split_credits(spark, d):
    return matching.credits_table(titled(spark, d), "id", "credits")


@query("SELECT p_partkey AS id, 'csv:' || left(sha256(lower(trim(p_name)) || chr(31) || lower(trim(p_brand))), 32) AS derived FROM part")
def derived_id(spark, d):
    return titled(spark, d).select("id", text.derived_id(F.col("p_name"), F.col("p_brand")).alias("derived"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 'BR' || 'BM' || CAST(c_custkey % 10 AS VARCHAR) || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS isrc FROM customer")
def isrc_parse(spark, d):
    id_ = F.col("c_custkey")
    number = F.lpad(id_.cast("string"), 7, "0")
    third = (id_ % 10).cast("string")
    raw = F.when(id_ % 4 == 0, F.concat(F.lit("br-bm"), third, F.lit("-"), number)).when(id_ % 4 == 1, F.concat(F.lit(" BRBM"), third, number)).when(id_ % 4 == 2, F.concat(F.lit("BR BM"), third, F.lit(" "), number)).otherwise(F.concat(F.lit("B1BM"), third, number))
    return table(spark, d, "customer").select(id_.alias("id"), text.isrc(raw).alias("isrc"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS precision,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END AS exact FROM orders""")
def release_date_parse(spark, d):
    id_, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(id_ % 5 == 0, day).when(id_ % 5 == 1, F.left(day, F.lit(7))).when(id_ % 5 == 2, F.left(day, F.lit(4))).when(id_ % 5 == 3, F.lit("1999-02-31")).otherwise(F.lit("75"))
    year, precision, exact = text.release_date(F.col("raw"))
    return table(spark, d, "orders").select(id_.alias("id"), raw.alias("raw")).select("id", year.alias("year"), precision.alias("precision"), exact.alias("exact"))


ASKED_SQL = "asked AS (SELECT id AS row_id, CASE WHEN id % 4 = 0 THEN id WHEN id % 4 = 1 THEN id + 10000000 END AS external_id, CASE WHEN id % 9 = 0 THEN 'nobody|nothing' ELSE match_key END AS match_key, duration_ms + (id % 5) * 1500 AS duration_ms FROM keyed)"


def asked(spark, d):
    keyed = titled(spark, d).select("id", text.match_key(F.col("title"), F.col("credits")).alias("match_key"), "duration_ms")
    rows = keyed.select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, F.col("id") + 10_000_000).alias("external_id"),
        F.when(F.col("id") % 9 == 0, "nobody|nothing").otherwise(F.col("match_key")).alias("match_key"), (F.col("duration_ms") + F.col("id") % 5 * 1500).alias("duration_ms"),
    )
    return rows, keyed


@query(f"""WITH {MATCH_SQL}, {ASKED_SQL},
c AS (SELECT row_id, t.id, 1 AS tier, 0 AS gap FROM asked a JOIN keyed t ON t.id = a.external_id
 UNION ALL SELECT row_id, t.id, 2, abs(a.duration_ms - t.duration_ms) FROM asked a JOIN keyed t USING (match_key) WHERE abs(a.duration_ms - t.duration_ms) <= 2000
 UNION ALL SELECT row_id, min(t.id), 3, 0 FROM asked a JOIN keyed t USING (match_key) GROUP BY row_id),
b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY tier, gap, id) AS n FROM c)
SELECT a.row_id, b.id AS track_id, CASE tier WHEN 1 THEN 'id' WHEN 2 THEN 'key_duration' WHEN 3 THEN 'key' ELSE 'none' END AS match_kind FROM asked a LEFT JOIN b ON b.row_id = a.row_id AND n = 1""")
def match_chain(spark, d):
    return matching.match_chain(*asked(spark, d))


@query(f"WITH {MATCH_SQL} SELECT match_key, min(id) AS id FROM keyed WHERE match_key <> '|' GROUP BY 1 HAVING count(DISTINCT id) = 1")
def match_unique_key(spark, d):
    return matching.unique_keys(asked(spark, d)[1])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_existing(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 2)")
def dup_group_members(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return part.join(part.groupBy("p_name").count().where("count >= 2"), "p_name", "left_semi").select("p_partkey", "p_name")


@query("SELECT l_orderkey, min(rn) AS first_row FROM (SELECT l_orderkey, l_partkey * 100 + l_linenumber AS rn FROM lineitem) GROUP BY 1")
def dedupe_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("first_row"))
    return matching.first_of(rows, ["l_orderkey"], "first_row").distinct()


RAW_SQL = """raw AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN ' ' || upper(p_type) ELSE lower(p_type) END AS genre,
 CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS energy, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS tempo, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 12 AS INTEGER) END AS key FROM part)"""


def raw(spark, d):
    id_ = F.col("p_partkey")
    genre = F.when(id_ % 8 == 0, "  ").when(id_ % 8 == 1, None).when(id_ % 8 == 2, F.concat(F.lit(" "), F.upper("p_type"))).otherwise(F.lower("p_type"))
    return table(spark, d, "part").select(id_.alias("id"), genre.alias("genre"), F.when(id_ % 5 != 0, F.col("p_size").cast("double")).alias("energy"), F.when(id_ % 7 != 0, F.col("p_retailprice")).alias("tempo"), F.when(id_ % 3 != 0, (id_ % 12).cast("int")).alias("key"))


MEDIAN_SQL = RAW_SQL + """, g AS (SELECT nullif(lower(trim(genre)), '') AS genre, energy, tempo, key FROM raw),
m AS (SELECT genre, quantile_cont(energy, 0.5) AS energy, quantile_cont(tempo, 0.5) AS tempo, quantile_cont(CAST(key AS DOUBLE), 0.5) AS key FROM g WHERE genre IS NOT NULL GROUP BY 1),
a AS (SELECT quantile_cont(energy, 0.5) AS energy, quantile_cont(tempo, 0.5) AS tempo, quantile_cont(CAST(key AS DOUBLE), 0.5) AS key FROM g)"""


@query(f"WITH {MEDIAN_SQL} SELECT * FROM m UNION ALL SELECT NULL, * FROM a")
def median_profile(spark, d):
    return matching.medians(raw(spark, d), "genre", ["energy", "tempo", "key"])


@query(f"""WITH {MEDIAN_SQL} SELECT id, raw.genre, coalesce(raw.energy, m.energy, a.energy, 0) AS energy, coalesce(raw.tempo, m.tempo, a.tempo, 0) AS tempo, coalesce(CAST(raw.key AS DOUBLE), round(coalesce(m.key, a.key, 0))) AS key,
 raw.energy IS NULL OR raw.tempo IS NULL OR raw.key IS NULL AS is_imputed,
 concat_ws(',', CASE WHEN raw.energy IS NULL THEN 'energy' END, CASE WHEN raw.tempo IS NULL THEN 'tempo' END, CASE WHEN raw.key IS NULL THEN 'key' END) AS imputed_names
 FROM raw LEFT JOIN m ON m.genre = nullif(lower(trim(raw.genre)), '') CROSS JOIN a""")
def impute_median(spark, d):
    return matching.impute(raw(spark, d), "genre", ["energy", "tempo"], ["key"]).withColumn("imputed_names", F.concat_ws(",", "imputed_names"))


@query("""WITH k AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'key_duration' WHEN 2 THEN 'key' ELSE 'none' END AS match_kind, o_orderkey % 10 = 0 AS duplicate, o_orderkey % 7 = 0 AS imputed FROM orders),
c AS (SELECT count(*) AS rows_read, count(*) FILTER (match_kind <> 'none') AS matched, count(*) FILTER (match_kind = 'id') AS by_id, count(*) FILTER (match_kind = 'key_duration') AS by_key_duration, count(*) FILTER (match_kind = 'key') AS by_key,
 count(*) FILTER (match_kind <> 'none' AND duplicate) AS duplicates, count(*) FILTER (match_kind <> 'none' AND imputed) AS imputed FROM k)
SELECT *, round(matched / rows_read, 6) AS match_rate, round((by_key_duration + by_key) / matched, 6) AS fallback_rate, round(imputed / matched, 6) AS imputation_rate FROM c""")
def import_quality(spark, d):
    id_ = F.col("o_orderkey")
    kind = F.when(id_ % 4 == 0, "id").when(id_ % 4 == 1, "key_duration").when(id_ % 4 == 2, "key").otherwise("none")
    return matching.import_quality(table(spark, d, "orders").select(kind.alias("match_kind"), (id_ % 10 == 0).alias("duplicate"), (id_ % 7 == 0).alias("imputed")))


@query("""WITH s AS (SELECT l_orderkey AS playlist, l_partkey AS track, min(l_orderkey * 10000 + l_linenumber * 1000 + l_partkey % 997) AS pos FROM lineitem GROUP BY ALL)
SELECT playlist, min(pos) AS first_row, string_agg(CAST(track AS VARCHAR), ',' ORDER BY pos, track) AS track_ids FROM s GROUP BY 1""")
def playlist_accumulate(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_partkey").alias("track"), (F.col("l_orderkey") * 10000 + F.col("l_linenumber") * 1000 + F.col("l_partkey") % 997).alias("row_id"))
    return matching.accumulate(rows).withColumn("track_ids", F.concat_ws(",", F.col("track_ids").cast("array<string>")))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def sink_idempotent_append(spark, d):
    fresh = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sinks.only_new(fresh.unionByName(fresh), fresh.where("id % 3 = 0"), "id")


@query("""WITH f AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'NEW' END AS isrc FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000000, c_name, NULL FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(f.id, c.c_custkey) AS id, CASE WHEN f.id IS NOT NULL THEN f.name ELSE c.c_name END AS name, coalesce(f.isrc, CASE WHEN c.c_custkey IS NOT NULL THEN 'OLD' END) AS isrc FROM customer c FULL JOIN f ON f.id = c.c_custkey""")
def upsert_snapshot(spark, d):
    customer = table(spark, d, "customer")
    id_ = F.col("c_custkey")
    target = customer.select(id_.alias("id"), F.col("c_name").alias("name"), F.lit("OLD").alias("isrc"))
    changed = customer.where(id_ % 2 == 0).select(id_.alias("id"), F.upper("c_name").alias("name"), F.when(id_ % 4 != 0, "NEW").alias("isrc"))
    added = customer.where(id_ % 5 == 0).select((id_ + 1_000_000_000).alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("isrc"))
    return matching.upsert(target, changed.unionByName(added), "id", ["isrc"])


REFERENCES_SQL = "refs AS (SELECT s_suppkey AS id, s_suppkey % 6 = 0 AS is_enriched, CAST(s_suppkey % 7 AS INTEGER) AS attempts FROM supplier)"


def references(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6 == 0).alias("is_enriched"), (F.col("s_suppkey") % 7).cast("int").alias("attempts"))


@query(f"WITH {REFERENCES_SQL} SELECT * FROM refs WHERE NOT is_enriched AND attempts < 5 ORDER BY attempts, id LIMIT 50")
def pending_queue(spark, d):
    return matching.pending(references(spark, d), 50)


@query(f"WITH {REFERENCES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'found' ELSE '' END AS detail, is_enriched OR id % 3 = 0 AS is_enriched, CASE WHEN id % 3 = 0 THEN attempts ELSE attempts + 1 END AS attempts FROM refs")
def enrich_update(spark, d):
    found = references(spark, d).where("id % 3 = 0").select("id", F.lit("found").alias("detail"))
    return matching.enrich(references(spark, d), found, "id")


@query("SELECT count(*) AS rows_read, count(o_orderkey) AS linked, count(*) - count(o_orderkey) AS missing FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) ON o_orderkey = l_orderkey")
def link_report(spark, d):
    orders = table(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("hit"))
    joined = table(spark, d, "lineitem").select("l_orderkey").join(orders, "l_orderkey", "left")
    return joined.agg(F.count("*").alias("rows_read"), F.count("hit").alias("linked"), (F.count("*") - F.count("hit")).alias("missing"))


CANDIDATES_SQL = TRACKS_SQL + ", cand AS (SELECT id, CASE WHEN id % 23 <> 0 THEN popularity END AS popularity, has_features, has_features AND energy IS NOT NULL AND genre IS NOT NULL AS is_complete, is_imputed FROM tracks)"
REASON_SQL = "CASE WHEN popularity IS NULL THEN 'missing_popularity' WHEN NOT has_features THEN 'missing_features' WHEN NOT is_complete THEN 'incomplete_features' WHEN is_imputed THEN 'imputed_features' END"


def candidates(spark, d):
    has = F.col("audio_features").isNotNull()
    flat = tracks(spark, d).select("id", F.when(F.col("id") % 23 != 0, F.col("popularity")).alias("popularity"), has.alias("has_features"), F.coalesce("audio_features.IsImputed", F.lit(False)).alias("is_imputed"), "audio_features.*")
    return flat.select("id", "popularity", "has_features", (F.col("has_features") & complete([*MEASURES, "Key", "Mode", "TimeSignature", "Genre"])).alias("is_complete"), "is_imputed")


@query(f"WITH {CANDIDATES_SQL} SELECT id, {REASON_SQL} AS reason FROM cand")
def eligibility_reason(spark, d):
    return candidates(spark, d).select("id", dataset.reason().alias("reason"))


#: 20260730 as four little-endian bytes, then the identifier's; 64-bit arithmetic in wider integers.
def split_sql(identifier: str) -> str:
    seed = ", ".join(str(20260730 >> s & 255) for s in (0, 8, 16, 24))
    return f"""CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], [x::HUGEINT for x in [{seed}]], [ascii(substr({identifier}, i, 1))::HUGEINT for i in range(1, length({identifier}) + 1)]),
 lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 1000000 AS BIGINT)"""


@query(f"SELECT o_orderkey AS id, {split_sql('CAST(o_orderkey AS VARCHAR)')} < 200000 AS is_test FROM orders")
def hash_split(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dataset.is_test(F.col("o_orderkey").cast("string")).alias("is_test"))


@query(f"""WITH {CANDIDATES_SQL}, r AS (SELECT *, {REASON_SQL} AS reason, {split_sql('CAST(id AS VARCHAR)')} < 200000 AS test FROM cand)
SELECT count(*) AS total, count(*) FILTER (reason = 'missing_popularity') AS missing_popularity, count(*) FILTER (reason = 'missing_features') AS missing_features, count(*) FILTER (reason = 'incomplete_features') AS incomplete_features,
 count(*) FILTER (reason IS NULL) AS eligible_measured, count(*) FILTER (reason = 'imputed_features') AS eligible_imputed, count(*) FILTER (reason = 'imputed_features') AS excluded_by_policy,
 count(*) FILTER (reason IS NULL AND NOT test) AS training_rows, count(*) FILTER (reason IS NULL AND test) AS test_rows FROM r""")
def dataset_stats(spark, d):
    return dataset.statistics(candidates(spark, d))


PREDICTED_SQL = "p AS (SELECT l_quantity AS y, l_quantity * 0.5 + l_discount * 100 AS f, l_orderkey % 5 = 0 AS test FROM lineitem)"


def predicted(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.5 + F.col("l_discount") * 100).alias("f"), (F.col("l_orderkey") % 5 == 0).alias("test"))


@query(f"WITH {PREDICTED_SQL} SELECT count(*) AS n, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p")
def regression_metrics(spark, d):
    return dataset.regression_metrics(predicted(spark, d), "y", "f")


@query(f"WITH {PREDICTED_SQL}, m AS (SELECT avg(y) AS m FROM p WHERE NOT test) SELECT count(*) AS n, round(avg(abs(y - m)), 6) AS mae, round(sqrt(avg((y - m) ** 2)), 6) AS rmse, round(1 - sum((y - m) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM p, m WHERE test")
def mean_baseline(spark, d):
    rows = predicted(spark, d)
    return dataset.mean_baseline(rows.where("NOT test"), rows.where("test"), "y")


@query("SELECT p_brand AS feature, round(sum(p_size / 100e0), 6) AS r2_drop, round(sqrt(sum((p_partkey % 9 / 10e0) ** 2)), 6) AS r2_sd, round(sum(p_size / 50e0), 6) AS mae_rise, round(sqrt(sum((p_partkey % 5 / 10e0) ** 2)), 6) AS mae_sd FROM part GROUP BY 1")
def importance_rollup(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("feature"), (F.col("p_size") / 100).alias("r2_drop"), (F.col("p_partkey") % 9 / 10).alias("r2_sd"), (F.col("p_size") / 50).alias("mae_rise"), (F.col("p_partkey") % 5 / 10).alias("mae_sd"))
    return dataset.importance_rollup(rows)


@query("""WITH l AS (SELECT event_id AS id, ts AS occurred_at, CAST(event_id % 5 AS INTEGER) AS attempts FROM events WHERE event_id % 3 <> 0 AND event_id % 20 <> 7 ORDER BY ts, event_id LIMIT 50),
o AS (SELECT *, id % 4 <> 1 AS ok, TIMESTAMP '2030-01-01 00:00:00' AS now FROM l)
SELECT id, occurred_at, CASE WHEN ok THEN now END AS processed_at, CASE WHEN ok THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN NOT ok AND attempts + 1 >= 5 THEN now END AS dead_lettered_at FROM o""")
def outbox_batch(spark, d):
    log = events_log(spark, d)
    return outbox.after_tick(log, log.select("id", (F.col("id") % 4 != 1).alias("ok")), "2030-01-01 00:00:00")


@query("""WITH b AS (SELECT CASE WHEN event_id % 10 = 0 THEN ' ' ELSE CAST(user_id AS VARCHAR) END AS k FROM events), g AS (SELECT k, count(*) AS n FROM b WHERE trim(k) <> '' GROUP BY 1)
SELECT count(*) FILTER (k NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) AS ingested, count(*) FILTER (k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) AS updated, CAST(sum(n - 1) AS BIGINT) AS duplicates, (SELECT count(*) FROM b WHERE trim(k) = '') AS skipped FROM g""")
def ingest_counters(spark, d):
    batch = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("k"))
    return outbox.ingest_counters(batch, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k")), "k")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return outbox.windowed(events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
