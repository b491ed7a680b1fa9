"""Given tables played as streams, services, files and tables that are kept up to date."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import matching
from cadenza.plans.registry import query
from cadenza.plans.views import table
from cadenza.sources import catalog_csv, rest, sinks
from cadenza.sources.sinks import shared_folder
from cadenza.streaming import outbox

#: Of the replay: ticks, and their distance in seconds.
TICKS, SECONDS = 6, 5
MIDNIGHT = "2030-01-01 00:00:00"


def unreliable(id_: int, payload: str, attempt: int) -> None:
    """A receiver that refuses a message as often as its id says."""
    if attempt <= id_ % 8:
        raise ConnectionError(f"{payload} refused")


@query(f"""WITH m AS (SELECT event_id AS id, event_type AS payload, event_id % 8 AS refusals, event_id % {TICKS} AS tick FROM events),
a AS (SELECT *, CAST(least(refusals + 1, 5, {TICKS} - tick) AS INTEGER) AS attempts FROM m),
s AS (SELECT *, TIMESTAMP '{MIDNIGHT}' + to_seconds({SECONDS} * (tick + attempts - 1)) AS last FROM a)
SELECT id, attempts, CASE WHEN attempts > refusals THEN last END AS processed_at, CASE WHEN attempts = 5 AND refusals >= 5 THEN last END AS dead_lettered_at,
  CASE WHEN attempts <= refusals THEN payload || ' refused' END AS error FROM s""")
def outbox_dispatch(spark, d):
    """Events enter the log over several ticks; after each the stream stops, and the next one goes on from its checkpoint."""
    log, out, checkpoint = (shared_folder(spark, n) for n in ("log", "attempts", "checkpoint"))
    id_, tick = F.col("event_id"), F.col("event_id") % TICKS
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(MIDNIGHT)) + SECONDS * tick)
    messages = table(spark, d, "events").select(id_.alias("id"), F.col("event_type").alias("payload"), at.alias("at"), tick.alias("tick"))
    buckets = max(64, -(-messages.count() // outbox.BUCKET_ROWS))
    clock = spark.range(TICKS).select(F.lit(outbox.CLOCK).cast("long").alias("id"), F.lit("").alias("payload"), F.timestamp_seconds(F.unix_timestamp(F.lit(MIDNIGHT)) + SECONDS * F.col("id")).alias("at"), F.col("id").alias("tick"))
    for k in range(TICKS):
        messages.unionByName(clock).where(F.col("tick") == k).drop("tick").write.mode("append").parquet(log)
        stream = spark.readStream.schema("id long, payload string, at timestamp").parquet(log)
        outbox.dispatch_messages(stream, unreliable, out, checkpoint, SECONDS, buckets=buckets).awaitTermination()
    found = outbox.marks(spark.read.schema(outbox.ATTEMPTS).parquet(out))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("processed_at", "dead_lettered_at")})


#: Places of a block of a service's rows; a block is a folder of its own.
BLOCK = 1 << 16


@lru_cache(maxsize=4)
def block(folder: str, number: int) -> tuple:
    """The rows of a block in order, and their places; a task that asks page by page reads each block once."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    source, path = fs.FileSystem.from_uri(f"{folder}/block={number}")
    if source.get_file_info(path).type == fs.FileType.NotFound:
        return None, []
    rows = pq.read_table(path, filesystem=source, partitioning=None).sort_by("place")
    return rows, rows.column("place").to_numpy()


def served(offset: int, size: int, options: dict) -> rest.Answer:
    """A service that gives the rows of a folder in the order of ``place``, ``cap`` at a time, the first ``total`` of them."""
    total = int(options["total"])
    last = min(offset + min(size, int(options.get("cap", 1000))), total)
    found: list[dict] = []
    for number in range(offset // BLOCK, (last - 1) // BLOCK + 1 if last > offset else 0):
        rows, places = block(options["folder"], number)
        first, end = np.searchsorted(places, [offset, last]).tolist()
        found += rows.slice(first, end - first).to_pylist() if end > first else []
    return 200, {}, {"total": total, "items": [None if x["id"] is None else x for x in found]}


def service(spark, rows, name: str) -> tuple[str, int]:
    """Rows (place, id, name) as the folder of ``served``, and their number."""
    folder = shared_folder(spark, name)
    rows.withColumn("block", F.floor(F.col("place") / BLOCK)).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, spark.read.parquet(folder).count()


SERVED = "cadenza.plans.streams:served"


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0")
def src_rest_pages(spark, d):
    """Read in pages of 50 from a service that gives 20 at a time, and nothing for every seventh item."""
    key = F.col("s_suppkey")
    folder, total = service(spark, table(spark, d, "supplier").select(key.alias("place"), F.when(key % 7 != 0, key).alias("id"), F.col("s_name").alias("name")), "service")
    return rest.read_pages(spark, "id long, name string", transport=SERVED, folder=folder, total=total, cap=20)


ITEMS_OF_RUNS = """WITH i AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 17 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN 't' || (p_partkey - 4) ELSE 't' || p_partkey END AS id,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey < (SELECT count(*) // 2 FROM part) THEN 0 ELSE 1 END AS run FROM part),
b AS (SELECT *, trim(id) = '' OR name = '' AS blank FROM i),
k AS (SELECT run, id, count(*) AS n, arg_min(name, place) AS name FROM b WHERE NOT blank GROUP BY run, id),
f AS (SELECT *, min(run) OVER (PARTITION BY id) AS first_run, max(run) OVER (PARTITION BY id) AS last_run FROM k)"""


def ingested(spark, d):
    """The folders of a catalogue and its counters: items of a service that has half of them when the first run comes."""
    key = F.col("p_partkey")
    own = F.when(key % 17 == 0, " ").when(key % 5 == 0, F.concat(F.lit("t"), (key - 4).cast("string"))).otherwise(F.concat(F.lit("t"), key.cast("string")))
    folder, total = service(spark, table(spark, d, "part").select(key.alias("place"), own.alias("id"), F.when(key % 23 == 0, "").otherwise(F.col("p_name")).alias("name")), "service")
    target, counters, checkpoint = (shared_folder(spark, n) for n in ("catalogue", "counters", "checkpoint"))
    for there in (total // 2, total):
        items = rest.stream_pages(spark, "id string, name string, position long", transport=SERVED, folder=folder, total=there, cap=37)
        outbox.ingest_stream(items, target, counters, checkpoint).awaitTermination()
    return target, counters


@query(f"""{ITEMS_OF_RUNS} SELECT r.run::BIGINT AS run, (SELECT count(*) FROM f WHERE f.run = r.run AND first_run = r.run) AS ingested, (SELECT count(*) FROM f WHERE f.run = r.run AND first_run < r.run) AS updated,
  (SELECT count(*) FROM b WHERE b.run = r.run AND blank) AS skipped, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM k WHERE k.run = r.run) AS duplicates, (SELECT count(*) FROM b WHERE b.run = r.run) AS total FROM (SELECT DISTINCT run FROM i) r""")
def ingest_stream_counters(spark, d):
    return spark.read.schema("ingested long, updated long, skipped long, duplicates long, total long, run long").parquet(ingested(spark, d)[1])


@query(f"{ITEMS_OF_RUNS} SELECT id, name, first_run::BIGINT AS first_run FROM f WHERE run = last_run")
def ingest_stream_catalogue(spark, d):
    return spark.read.parquet(ingested(spark, d)[0]).select("id", "name", "first_run")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN upper(c_name) || '!' ELSE c_name END AS name FROM customer")
def sink_upsert(spark, d):
    """A table of hash buckets, updated twice with the same rows."""
    path = shared_folder(spark, "snapshot")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sinks.upsert(rows.where("id % 2 = 0 OR id % 10 = 3"), path, "id")
    for _ in range(2):
        sinks.upsert(rows.where("id % 2 = 1 OR id % 10 = 3").withColumn("name", F.when(F.col("id") % 10 == 3, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name"))), path, "id")
    return spark.read.parquet(path).select("id", "name")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def sink_bucketed_append(spark, d):
    """Two appends to a bucketed table, the second with rows that are there already."""
    path = shared_folder(spark, "bucketed")
    name = "t" + path.rsplit("-", 1)[1]
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sinks.append_bucketed(rows.where("id % 3 = 0"), name, path, "id", 8)
    sinks.append_bucketed(rows, name, path, "id", 8)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return spark.read.parquet(path)


def files_of(rows: int) -> int:
    """As many files that none has much over a million rows, which one task sorts."""
    return max(5, -(-rows // 1_000_000))


@query("""WITH l AS (SELECT 'list ' || l_suppkey AS playlist, l_partkey AS track, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), s AS (SELECT playlist, track, min(n) AS n FROM l GROUP BY ALL)
SELECT playlist, string_agg(CAST(track AS VARCHAR), ',' ORDER BY n) AS track_ids FROM s GROUP BY 1""")
def playlist_file_order(spark, d):
    """Lines go out as files of unlike sizes, in order of their names, and come back in the order in which they stand there."""
    path = sinks.shared_folder(spark, "playlists")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select(*keys)
    rows = lines.repartitionByRange(files_of(lines.count()), *keys).sortWithinPartitions(*keys)
    rows.select(F.lit("u").alias("user"), F.lit("a").alias("artist"), F.col("l_partkey").cast("string").alias("track"), F.concat(F.lit("list "), F.col("l_suppkey").cast("string")).alias("playlist")).write.csv(path, header=True, quoteAll=True, escape="\\")
    lists = matching.accumulate(catalog_csv.read_playlists(spark, path, place="row_id").select("row_id", "playlist", "track"))
    return lists.select("playlist", F.concat_ws(",", "track_ids").alias("track_ids"))
