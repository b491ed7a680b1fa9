"""An event log processed in micro-batches: at least once, with attempts and a dead-letter state."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from cadenza.sources import sinks

BATCH, MOST_ATTEMPTS = 50, 5
#: Seconds between the ticks of the log's dispatch, of the enrichment and of the ingestion.
INTERVALS = {"dispatch": 5, "enrichment": 6 * 3600, "ingestion": 3600}

log_of_jobs = logging.getLogger("cadenza.jobs")


def due(log: DataFrame, batch: int = BATCH) -> DataFrame:
    """Next messages: neither processed nor dead, oldest first, ties by id."""
    return log.where("processed_at IS NULL AND dead_lettered_at IS NULL").orderBy("occurred_at", "id").limit(batch)


def after_tick(log: DataFrame, outcome: DataFrame, now: str, batch: int = BATCH, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """The messages of one tick after it: processed, or with one attempt more, dead at the last. ``outcome``: id, ok."""
    tried = due(log, batch).join(outcome, "id", "left")
    ok, at = F.coalesce("ok", F.lit(False)), F.lit(now).cast("timestamp_ntz")
    attempts = F.when(ok, F.col("attempts")).otherwise(F.col("attempts") + 1)
    return tried.select("id", "occurred_at", F.when(ok, at).alias("processed_at"), attempts.alias("attempts"), F.when(~ok & (attempts >= most_attempts), at).alias("dead_lettered_at"))


def dispatch(spark: SparkSession, source: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: int = INTERVALS["dispatch"]) -> StreamingQuery:
    """New files of the log go to ``handle`` batch by batch; a failed batch is tried again from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


ATTEMPTS = "id long, attempt int, at timestamp, ok boolean, dead boolean, error string"
#: The id of rows that only bring the time.
CLOCK = -1


#: Groups of the state, by a hash of the id; a checkpoint keeps the number that it began with. About ``BUCKET_ROWS`` messages
#: that wait in a bucket are few for its task, and many for a call to the state.
BUCKETS, BUCKET_ROWS = 1 << 10, 1 << 13


class Delivery(StatefulProcessor):
    """A bucket of messages: each tried when it comes and again after each interval, until it is delivered or has failed too often.

    State, only of messages that have failed: attempts so far, time of the next one, the payload; those of a bucket lie in
    one Arrow table, so that the state is asked once for a bucket and batch, not several times for each message. A timer of
    the event time, at the first of these times, brings a bucket back without new rows. A message that comes again in a
    later batch starts anew. ``deliver`` (id, payload, attempt) raises where it fails.
    """

    def __init__(self, deliver: Callable[[int, str, int], None], seconds: int, most_attempts: int):
        self.deliver, self.wait, self.most_attempts = deliver, 1000 * seconds, most_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "timer long, messages binary")

    def held(self) -> tuple[int | None, dict[int, tuple]]:
        """The bucket's timer, and (attempts, due, payload) of each message that waits."""
        found = self.state.get()
        if found is None:
            return None, {}
        ids, attempts, due, payloads = (c.to_pylist() for c in pa.ipc.open_stream(found[1]).read_all().columns)
        return found[0], dict(zip(ids, zip(attempts, due, payloads), strict=True))

    def hold(self, timer: int | None, waiting: dict[int, tuple], fired: int | None = None) -> None:
        first = min((due for _, due, _ in waiting.values()), default=None)
        if timer not in (None, first, fired):
            self.handle.deleteTimer(timer)
        if first is not None and first != timer:
            self.handle.registerTimer(first)
        if waiting:
            columns = zip(*waiting.values(), strict=True)
            table = pa.table([pa.array(list(waiting), pa.int64()), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.string()), strict=True))], names=["id", "attempts", "due", "payload"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.state.update((first, sink.getvalue().to_pybytes()))
        elif timer is not None:
            self.state.clear()

    def tried(self, messages: Iterable[tuple[int, str, int, int]], waiting: dict[int, tuple]) -> pd.DataFrame:
        """The attempts for messages (id, payload, attempt, now); those to be tried again are in ``waiting`` afterwards."""
        rows = []
        for id_, payload, attempt, now in messages:
            error = None
            try:
                self.deliver(id_, payload, attempt)
            except Exception as e:  # noqa: BLE001
                error = str(e)
            dead = error is not None and attempt >= self.most_attempts
            if error is not None and not dead:
                waiting[id_] = (attempt, now + self.wait, payload)
            else:
                waiting.pop(id_, None)
            rows.append((id_, attempt, now, error is None, dead, error))
        return pd.DataFrame(rows, columns=["id", "attempt", "now", "ok", "dead", "error"])

    def handleInputRows(self, key, rows, timerValues):
        timer, waiting = self.held()
        seen = {CLOCK}
        for batch in rows:
            fresh = []
            for id_, payload, now in zip(batch["id"].tolist(), batch["payload"].tolist(), batch["now"].tolist(), strict=True):
                if id_ not in seen:  # a message that comes again in the same batch is the same message
                    seen.add(id_)
                    fresh.append((id_, payload, 1, now))
            if fresh:
                yield self.tried(fresh, waiting)
        self.hold(timer, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        timer, waiting = self.held()
        until = timerValues.getCurrentWatermarkInMs()
        ready = [(id_, payload, attempts + 1, due) for id_, (attempts, due, payload) in waiting.items() if due <= until]
        if ready:
            yield self.tried(ready, waiting)
        self.hold(timer, waiting, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def dispatch_messages(messages: DataFrame, deliver: Callable[[int, str, int], None], path: str, checkpoint: str, seconds: int = INTERVALS["dispatch"], most_attempts: int = MOST_ATTEMPTS, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Delivers a stream of messages (id, payload, at) with retries kept in state; attempts are appended to ``path``.

    ``at``: when the message entered the log; it drives the watermark, so rows of the id ``CLOCK`` may move the time on
    where no message comes. A restart goes on from the checkpoint: attempts and waiting messages are not lost.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed_ = messages.withWatermark("at", "0 seconds").select("id", "payload", "at", F.unix_millis("at").alias("now"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    tried = timed_.groupBy("bucket").transformWithStateInPandas(Delivery(deliver, seconds, most_attempts), "id long, attempt int, now long, ok boolean, dead boolean, error string", "append", "eventTime")
    found = tried.select("id", "attempt", F.timestamp_millis("now").alias("at"), "ok", "dead", "error")
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def marks(attempts: DataFrame) -> DataFrame:
    """The state of each message after its attempts: id, attempts, processed_at, dead_lettered_at, error of the last one."""
    last = attempts.groupBy("id").agg(F.max(F.struct("attempt", "at", "ok", "dead", "error")).alias("last"))
    return last.select("id", F.col("last.attempt").alias("attempts"), F.expr("CASE WHEN last.ok THEN last.at END").alias("processed_at"), F.expr("CASE WHEN last.dead THEN last.at END").alias("dead_lettered_at"), F.col("last.error").alias("error"))


def timed(name: str, tick: Callable[[], object], seconds: float, stop: threading.Event) -> int:
    """Runs a tick at once and then after each interval until ``stop`` is set; a failed tick is logged and not fatal.

    Returns how many ticks failed.
    """
    failed = 0
    while not stop.is_set():
        try:
            tick()
        except Exception:  # noqa: BLE001
            failed += 1
            log_of_jobs.exception("a tick of %s failed", name)
        stop.wait(seconds)
    return failed


def ingest_counters(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of a batch: new, updated, skipped for a blank key, repeated within the batch. One row."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    distinct = batch.where(~blank).groupBy(key).agg(F.count("*").alias("n")).join(known.select(key, F.lit(True).alias("known")), key, "left")
    counts = distinct.agg(F.count_if(F.col("known").isNull()).alias("ingested"), F.count_if("known").alias("updated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("duplicates"))
    return counts.crossJoin(F.broadcast(batch.agg(F.count_if(blank).alias("skipped"))))


def ingest(batch: DataFrame, run: int, target: str, counters: str, key: str = "id", name: str = "name", order: str = "position") -> None:
    """One run of an ingestion: the first row of each key with a name is added to, or replaces that of, the table ``target``.

    Safe to repeat: a row remembers the run that added it (``first_run``), so a run that is done again after a failure
    writes the same rows and counts the same. Counters, a row for each run: ingested, updated, skipped (blank key or name),
    duplicates (a key seen earlier in the run), total.
    """
    spark = batch.sparkSession
    # read several times below, so the source is asked once
    batch.write.mode("overwrite").parquet(f"{counters}_batches/{run}")
    batch = spark.read.schema(batch.schema).parquet(f"{counters}_batches/{run}")
    blank = (F.coalesce(F.trim(F.col(key)), F.lit("")) == "") | (F.coalesce(F.trim(F.col(name)), F.lit("")) == "")
    marked = batch.withColumn("__blank", blank)
    rest = [c for c in batch.columns if c not in (key, order)]
    first = marked.where("NOT __blank").groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__row"), F.count("*").alias("__n"))
    schema = batch.select(key, *rest).withColumn("first_run", F.lit(0).cast("long")).withColumn("bucket", F.lit(0)).schema
    known = sinks.read_or_empty(spark, target, schema).select(key, F.col("first_run").alias("__run"))
    # read again below: once for the table, once for the counters, so it is written first
    held = f"{counters}_runs/{run}"
    first.join(known, key, "left").select(key, *(f"__row.{c}" for c in rest), F.coalesce("__run", F.lit(run).cast("long")).alias("first_run"), "__n").write.mode("overwrite").parquet(held)
    done = spark.read.parquet(held)
    counts = done.agg(F.count_if(F.col("first_run") == run).alias("ingested"), F.count_if(F.col("first_run") != run).alias("updated"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicates"))
    totals = marked.agg(F.count_if("__blank").alias("skipped"), F.count("*").alias("total"))
    sinks.upsert(done.drop("__n"), target, key)
    row = counts.crossJoin(F.broadcast(totals)).select(F.lit(run).cast("long").alias("run"), "ingested", "updated", "skipped", "duplicates", "total")
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(counters)


def ingest_stream(items: DataFrame, target: str, counters: str, checkpoint: str, once: bool = True, seconds: int = INTERVALS["ingestion"]) -> StreamingQuery:
    """``ingest`` for each micro-batch of a stream of items (id, name, position and further columns)."""
    writer = items.writeStream.foreachBatch(lambda batch, run: ingest(batch, run, target, counters)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Beyond the catalogue's own needs: event-time windows with a watermark; the same for a batch and a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, key: str, order: str) -> DataFrame:
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
