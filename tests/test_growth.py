"""What keeps large inputs whole: order statistics, numbering, cells, streams, services, tables and ledgers that grow."""

import threading
import time
from datetime import UTC, datetime, timedelta
from email.utils import format_datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import cells, cooccurrence, matching, ml, ranks, similarity
from cadenza.plans import recommendation, streams
from cadenza.sources import catalog_csv, rest, sinks
from cadenza.streaming import outbox
from tests.conftest import SMALL


def test_medians_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 4000)) for v in rng.choice([0, 1.5, -3, *rng.normal(size=300)], n)] + [("c", None), ("e", None), ("f", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {g: (float(np.median(x)) if (x := [v for h, v in rows if h == g and v is not None]) else None) for g in "abcdef"}
    for most in (ranks.MOST_GROUPS, 2):
        monkeypatch.setattr(ranks, "MOST_GROUPS", most)
        assert {r.g: r.median for r in ranks.medians(df, ["g"], "v").collect()} == wanted
    monkeypatch.setattr(ranks, "ACCURACY", 100)  # brackets that matter: most rows lie outside
    monkeypatch.setattr(ranks, "MARGIN", 3)
    assert {r.g: r.median for r in ranks.medians(df, ["g"], "v").collect()} == wanted
    assert ranks.medians(df.where("false"), ["g"], "v").collect() == []
    plan = ranks.medians(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_rows_are_numbered_by_one_sort(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k")).repartition(7)
    got = ranks.numbered(df, [F.desc("k")], lambda rows: sinks.written(rows, "numbered"), 400).collect()
    order = sorted((r.k for r in df.collect()), reverse=True)
    assert sorted((r.row_number, r.k, r.page) for r in got) == [(n, k, (n - 1) // 400 + 1) for n, k in enumerate(order, 1)]
    assert ranks.numbered(df.where("false"), [F.desc("k")], lambda rows: sinks.written(rows, "numbered")).collect() == []


def test_items_in_few_baskets_are_pruned(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (2, 1), (2, 2), (2, 2), (3, 8), (4, None)], "basket long, item long")
    kept, totals = cooccurrence.frequent(rows, 2)
    assert {r.item for r in kept.collect()} == {1, 2} and {(r.item, r.total) for r in totals.collect()} == {(1, 2), (2, 2)}
    assert [tuple(r) for r in cooccurrence.pairs(rows).collect()] == [(1, 2, 2)]


@pytest.mark.parametrize("mode", similarity.MODES)
def test_cells_find_what_all_pairs_find(spark, mode):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    rows = [(k, (base[k % 60] + 0.01 * rng.normal(size=8)).tolist() if k else [0.0] * 8, "ab"[k % 2] if k % 7 else None, k % 5 == 0) for k in range(900)]
    items = spark.createDataFrame(rows, "id long, vector array<double>, genre string, is_imputed boolean")
    index = similarity.index_of(items, "vector", 8)
    seeds = index.where("id % 10 = 0")
    plain = sorted(map(tuple, similarity.neighbours(seeds, index, 8, mode).select("seed_id", "id", "rank", "score", "fell_back").collect()))
    found, skipped = cells.neighbours(seeds, cells.build(index, 64), 8, mode)
    assert sorted(map(tuple, found.select("seed_id", "id", "rank", "score", "fell_back").collect())) == plain
    assert skipped > 0.5 or mode != "off"
    whole, none = cells.neighbours(seeds, cells.build(index, 1), 8, mode)
    assert sorted(map(tuple, whole.select("seed_id", "id", "rank", "score", "fell_back").collect())) == plain and none == 0
    assert cells.neighbours(seeds.where("false"), cells.build(index, 4), 8, mode)[0].collect() == []


@pytest.mark.parametrize("mode", similarity.MODES)
def test_a_task_gives_only_ids_and_scores_of_its_best_items(spark, mode):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=8).tolist() if k else [0.0] * 8, "ab"[k % 2] if k % 7 else None, k % 5 == 0) for k in range(1200)]
    index = similarity.index_of(spark.createDataFrame(rows, "id long, vector array<double>, genre string, is_imputed boolean"), "vector", 8)
    seeds = index.where("id % 60 = 0")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = similarity._nearest(similarity._asked(seeds), index.coalesce(1), 7, mode, similarity.BOOST)
        assert found.columns == ["seed_id", "id", "cosine", "score", "fell_back"] and 0 < found.count() <= 20 * 7
        plain = sorted(map(tuple, similarity.scored(seeds, index, mode).select("seed_id", "id", "cosine", "score", "fell_back").withColumn("n", F.expr("row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, id)")).where("n <= 7").drop("n").collect()))
        assert sorted(map(tuple, found.collect())) == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_all_pairs_come_in_bounded_batches(spark, monkeypatch):
    rows = [(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(40)] + [(40, [0.0, 0.0, 0.0])]
    index = similarity.standardised(spark.createDataFrame([(*r, "a", False) for r in rows], "id long, vector array<double>, genre string, is_imputed boolean"), "vector", spark.createDataFrame([([0.0] * 3, [1.0] * 3)], "means array<double>, deviations array<double>"))
    wanted = sorted(map(tuple, similarity.scored(index, index).select("seed_id", "id", "cosine").collect()))
    for most in (similarity.MOST_SEEDS, 9):
        monkeypatch.setattr(similarity, "MOST_SEEDS", most)
        assert sorted(map(tuple, similarity.cosines(index, index).collect())) == wanted
    assert similarity.cosines(index.where("false"), index).collect() == []


def test_a_service_reads_each_block_once(spark, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK", 10)
    rows = spark.range(1, 36).select(F.col("id").alias("place"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("id"), F.lit("x").alias("name"))
    folder, total = streams.service(spark, rows.where("place < 20 OR place >= 30"), "service")
    streams.block.cache_clear()
    found = [x for at in range(0, 36, 3) for x in streams.served(at, 3, {"folder": folder, "total": "36"})[2]["items"]]
    assert total == 25 and [x and x["id"] for x in found] == [k if k % 4 else None for k in [*range(1, 20), *range(30, 36)]]
    assert streams.block.cache_info().misses == 4
    assert streams.served(36, 3, {"folder": folder, "total": "36"})[2]["items"] == []


def test_files_grow_in_number_not_in_rows():
    assert [streams.files_of(n) for n in (0, 600_000, 36_000_000, 216_000_001)] == [5, 5, 36, 217]


def test_rows_of_a_frequent_key_are_dealt_out(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 100 != 7, F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))).alias("match_key"))
    facts = spark.createDataFrame([("often", 1), ("k1", 2), ("other", 3)], "match_key string, by_key int")
    wanted = sorted((r.row_id, r.match_key, r.by_key) for r in rows.join(facts, "match_key", "left").collect())
    for hot in (100, 10**6):
        assert sorted((r.row_id, r.match_key, r.by_key) for r in matching.by_frequent_key(rows, facts, "match_key", "row_id", hot).collect()) == wanted


def test_tracks_of_one_key_and_duration_meet_a_row_once(spark):
    tracks = spark.createDataFrame([(k, "a|b", 1000 * (k % 2)) for k in range(200)] + [(500, "a|b", None)], "id long, match_key string, duration_ms long")
    rows = spark.createDataFrame([(1, None, "a|b", 600), (2, None, "a|b", 500), (3, None, "a|b", 9000), (4, None, "c|d", 0), (5, 500, "a|b", 0)], "row_id long, external_id long, match_key string, duration_ms long")
    found = matching.match_chain(rows, tracks)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "key_duration"), (2, 0, "key_duration"), (3, 0, "key"), (4, None, "none"), (5, 500, "id")]


def test_matching_broadcasts_no_table_that_grows(spark):
    from cadenza.plans import curation

    physical = curation.match_chain(spark, SMALL)._jdf.queryExecution().sparkPlan().toString().splitlines()
    # only the list of frequent keys, for rows and for facts
    assert sum("BroadcastHashJoin" in x for x in physical) == 2 and sum("SortMergeJoin" in x for x in physical) == 5


def lines(numbers, path):
    path.write_text('"user","artist","track","playlist"\n' + "".join(f'"u","a","t{n}","p{n % 3}"\n' for n in numbers))


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    many.mkdir()
    numbers = [k * 31 % 5000 for k in range(5000)]
    lines(numbers, one / "a.csv")
    for name, part in (("a", slice(0, 50)), ("b", slice(50, 4000)), ("c", slice(4000, 4001)), ("d", slice(4001, 5000))):
        lines(numbers[part], many / f"{name}.csv")
    wanted = {f"p{p}": [f"t{n}" for n in numbers if n % 3 == p] for p in range(3)}
    for folder, split in ((one, "128m"), (many, "128m"), (one, "9k"), (many, "9k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            rows = catalog_csv.read_playlists(spark, f"file://{folder}", place="row_id")
            assert split == "128m" or rows.rdd.getNumPartitions() > 3
            assert {r.playlist: r.track_ids for r in matching.accumulate(rows).collect()} == wanted
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_retry_after_may_be_a_date():
    now = datetime(2030, 1, 1, tzinfo=UTC)
    assert rest.wait_of(format_datetime(now + timedelta(seconds=7), usegmt=True), 1, now) == 7
    assert rest.wait_of(format_datetime(now - timedelta(days=7), usegmt=True), 1, now) == 0
    assert rest.wait_of("Tue, 01 Jan 2030 00:00:09", 1, now) == 9  # no zone: UTC
    assert rest.wait_of("1e9", 1) == rest.LONGEST_WAIT and rest.wait_of("-3", 1) == 0
    assert rest.wait_of("soon", 1.5) == rest.wait_of(None, 1.5) == rest.wait_of("nan", 1.5) == 1.5
    waits = []
    answers = [(429, {"retry-after": format_datetime(datetime.now(UTC) + timedelta(seconds=20), usegmt=True)}, None), (200, {}, "ok")]
    assert rest.with_retry(lambda: answers.pop(0), sleep=waits.append) == "ok" and 10 < waits[0] <= 20


def capped(offset, size, options):
    total, cap = int(options["total"]), int(options["cap"])
    return 200, {}, {"total": total, "items": [{"id": k} if k % 11 else None for k in range(offset, min(offset + size, offset + cap, total))]}


@pytest.mark.parametrize("total", [0, 1, 59, 100])
def test_short_pages_lose_nothing(total):
    wanted = [(k, k) for k in range(total) if k % 11]
    for cap in range(1, 61):
        for tasks, size in ((1, 50), (4, 7), (3, 50)):
            options = {"transport": "tests.test_growth:capped", "total": total, "cap": cap, "size": size, "tasks": tasks}
            reader = rest._PagedReader(["id", "position"], options)
            assert [x for p in reader.partitions() for x in reader.read(p)] == wanted
            stream = rest._PagedStream(["id", "position"], options)
            end, middle = stream.latestOffset(), {"next": total // 3}
            assert [x for a, b in ((stream.initialOffset(), middle), (middle, end)) for p in stream.partitions(a, b) for x in stream.read(p)] == wanted


def test_upsert_rewrites_changed_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(400).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    assert len(sinks.upsert(rows, path, "id", 16)) == 16

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}

    before = files()
    assert sinks.upsert(rows, path, "id", 16) == [] and files() == before
    fresh = spark.createDataFrame([(7, "new"), (8, None)], "id long, name string")
    changed = sinks.upsert(fresh, path, "id", 16)
    assert 1 <= len(changed) <= 2
    left = {p for p in before if not any(f"bucket={b}/" in str(p) for b in changed)}
    assert left and {p: m for p, m in files().items() if p in left} == {p: before[p] for p in left}
    got = {r.id: r.name for r in spark.read.parquet(path).collect()}
    assert got == {k: "new" if k == 7 else None if k == 8 else f"n{k}" for k in range(400)}
    assert sinks.upsert(fresh, path, "id", 16) == []


def test_a_bucketed_target_is_not_shuffled(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("x").alias("name"))
    sinks.append_bucketed(rows.where("id % 2 = 0"), "grown", f"file://{tmp_path}/b", "id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = sinks.only_new(rows, spark.table("grown"), "id")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1, plan  # of the fresh rows
        sinks.append_bucketed(rows, "grown", f"file://{tmp_path}/b", "id", 4)
        sinks.append_bucketed(rows, "grown", f"file://{tmp_path}/b", "id", 4)
        assert sorted(r.id for r in spark.table("grown").collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE grown")


def test_of_promotions_at_once_each_sees_those_before(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    maes = [5.0, 4.0, 3.0, 6.0, 2.0, 4.5]
    saved = []

    def save(k, mae):
        own = {"version": f"v{k}", "digest": "d", "size_bytes": 1, "mae": mae, "baseline_mae": 10.0, "metrics": "{}"}
        saved.append(sinks.commit(spark, f"{path}/versions", sinks.VERSIONS, lambda known, number: own | {"sequence": number}))

    def together(work, cases):
        threads = [threading.Thread(target=work, args=c) for c in cases]
        [t.start() for t in threads]
        [t.join() for t in threads]

    together(save, list(enumerate(maes)))
    assert sorted(s["sequence"] for s in saved) == [1, 2, 3, 4, 5, 6]
    won = {}
    together(lambda k: won.__setitem__(k, sinks.promote(spark, path, f"v{k}")), [(k,) for k in range(6)])
    raised = sorted((r.at, r.version) for r in sinks.entries(spark, f"{path}/promotions", sinks.PROMOTIONS).collect())
    in_turn = [maes[int(v[1:])] for _, v in raised]
    assert [a for a, _ in raised] == list(range(1, len(raised) + 1)) and in_turn == sorted(in_turn, reverse=True)
    assert {k for k, w in won.items() if w} == {int(v[1:]) for _, v in raised}
    assert sinks.current(spark, path).version == "v4" and sinks.versions(spark, path).where("is_current").count() == 1
    assert not sinks.create_only(spark, f"{path}/promotions/{1:012d}", "other") and sinks.create_only(spark, f"{path}/other", "x")


def test_importance_of_slots_equals_numpy(spark):
    rng = np.random.default_rng(9)
    genre, x = rng.integers(0, 3, 240), rng.normal(size=240)
    y = 4 * x + np.array([0.0, 5.0, -3.0])[genre] + rng.normal(size=240) * 0.1
    rows = spark.createDataFrame([(k, float(a), f"g_{g}", float(b)) for k, (a, g, b) in enumerate(zip(x, genre, y))], "id long, x double, genre string, y double")
    model = ml.pipeline(["x"], ["genre"], "y", linear=True).fit(rows)
    slots = ml.slots_of(model, rows)
    assert slots[0] == ("x", "x") and {s for f, s in slots if f == "genre"} >= {"genre=g_0", "genre=g_1", "genre=g_2"}
    ready = model.transform(rows).select("id", ml.vector_to_array("features").alias("__x"), "y")
    own = {r.id: np.array(r["__x"]) for r in ready.collect()}
    met = {}
    for r in ml.partners(ready, "id", 5, 8).collect():
        met.setdefault(r["__p"], {})[r.id] = np.array(r["__x"])
    weights, base = np.array(model.stages[-1].coefficients), model.stages[-1].intercept

    def r2_mae(vectors):
        error = np.array([y[k] - (vectors[k] @ weights + base) for k in range(240)])
        return 1 - (error**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(error).mean()

    found = {r.slot: r for r in ml.permutation_importance(model, rows, None, "y", "id", buckets=8).collect()}
    whole = r2_mae(own)
    assert len(found) == len(slots)
    for k, (_, slot) in enumerate(slots):
        turned = [r2_mae({i: np.where(np.arange(len(v)) == k, met[p][i], v) for i, v in own.items()}) for p in range(5)]
        drops, rises = [whole[0] - t[0] for t in turned], [t[1] - whole[1] for t in turned]
        got = found[slot]
        assert np.allclose([got.r2_drop, got.r2_sd, got.mae_rise, got.mae_sd], [np.mean(drops), np.std(drops), np.mean(rises), np.std(rises)], atol=1e-9)
    assert [sorted(v.tolist()) for v in met[0].values()] != [] and sorted(v.tolist() for v in met[0].values()) == sorted(v.tolist() for v in own.values())


def stubborn(id_, payload, attempt):
    if id_ == 1 and attempt < 3 or id_ == 2:
        raise ConnectionError(f"{payload} {attempt}")


def test_messages_come_back_after_a_restart(spark, tmp_path):
    log, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("log", "out", "checkpoint"))

    def tick(k, ids):
        rows = [(i, f"m{i}", datetime(2030, 1, 1, 0, 0, 5 * k)) for i in [*ids, outbox.CLOCK]]
        spark.createDataFrame(rows, "id long, payload string, at timestamp").coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema("id long, payload string, at timestamp").parquet(log)
        query = outbox.dispatch_messages(stream, stubborn, out, checkpoint, 5, most_attempts=4)
        query.awaitTermination()
        return {r.id: r for r in outbox.marks(spark.read.schema(outbox.ATTEMPTS).parquet(out)).collect()}

    after = tick(0, [1, 2, 3, 3])
    assert set(after) == {1, 2, 3} and after[3].attempts == 1 and after[3].processed_at and after[1].attempts == after[2].attempts == 1
    assert after[1].processed_at is None and after[1].error == "m1 1"
    after = tick(1, [4])
    assert (after[1].attempts, after[2].attempts, after[4].attempts) == (2, 2, 1)
    for k in range(2, 6):
        after = tick(k, [])
    assert (after[1].attempts, after[1].processed_at, after[1].error) == (3, datetime(2030, 1, 1, 0, 0, 10), None)
    assert (after[2].attempts, after[2].processed_at, after[2].dead_lettered_at) == (4, None, datetime(2030, 1, 1, 0, 0, 15))


def test_ingestion_may_be_done_again(spark, tmp_path):
    target, counters = f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    batch = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("a", "later", 2), (" ", "z", 3), (None, "z", 4), ("c", "", 5)], "id string, name string, position long")
    more = spark.createDataFrame([("a", "new", 6), ("d", "w", 7)], "id string, name string, position long")
    for run, rows in ((0, batch), (0, batch), (1, more), (1, more)):
        outbox.ingest(rows, run, target, counters)
        time.sleep(0.01)
    assert {(r.id, r.name, r.first_run) for r in spark.read.parquet(target).collect()} == {("a", "new", 0), ("b", "y", 0), ("d", "w", 1)}
    got = {r.run: (r.ingested, r.updated, r.skipped, r.duplicates, r.total) for r in spark.read.parquet(counters).collect()}
    assert got == {0: (2, 0, 3, 1, 6), 1: (1, 1, 0, 0, 2)}


def test_a_stream_of_pages_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.range(90).select(F.col("id").alias("place"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"))
    folder, total = streams.service(spark, rows, "service")
    seen = []
    for there in (0, 31, 31, total):
        items = rest.stream_pages(spark, "id string, position long", transport=streams.SERVED, folder=folder, total=there, cap=4, size=9)
        query = items.writeStream.foreachBatch(lambda b, _: seen.append([r.position for r in b.collect()])).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert [sorted(s) for s in seen if s] == [list(range(31)), list(range(31, 90))]


def least_squares(train, test):
    """Errors on ``test`` of a linear model with one-hot genres, fitted on ``train`` (rows of ``learnable``)."""
    genres = sorted({r.genre for r in train})
    design = lambda rows: np.array([[r["size"], r.quantity, r.discount, *(r.genre == g for g in genres), 1.0] for r in rows], float)
    weights = np.linalg.lstsq(design(train), np.array([r.popularity for r in train]), rcond=None)[0]
    return np.array([r.popularity for r in test]), design(test) @ weights


def test_gate_and_folds_equal_least_squares(spark):
    import xxhash

    from cadenza.plans import QUERIES
    from cadenza.plans.recommendation import learnable
    from tests.conftest import SMALL

    rows = learnable(spark, SMALL).collect()
    truth, guess = least_squares([r for r in rows if not r.test], test := [r for r in rows if r.test])
    mean = np.mean([r.popularity for r in rows if not r.test])
    got = {r.model: r for r in QUERIES["model_gate"](spark, SMALL).collect()}
    for name, value in (("linear", guess), ("mean", np.full(len(truth), mean))):
        error = truth - value
        wanted = [np.abs(error).mean(), np.sqrt((error**2).mean()), 1 - (error**2).sum() / ((truth - truth.mean()) ** 2).sum()]
        assert np.allclose([got[name].mae, got[name].rmse, got[name].r2], wanted, atol=2e-6) and got[name].n == len(test)
        assert got[name].passes == (wanted[0] <= 0.95 * got["mean"].mae)
    fold = lambda r: np.int64(np.uint64(xxhash.xxh64_intdigest(str(r.l_partkey), seed=42)).astype(np.int64)) % 5
    scores = []
    for k in range(5):
        truth, guess = least_squares([r for r in rows if fold(r) != k], [r for r in rows if fold(r) == k])
        scores.append(1 - ((truth - guess) ** 2).sum() / ((truth - truth.mean()) ** 2).sum())
    row = QUERIES["model_cross_validation"](spark, SMALL).first()
    assert np.allclose([row.r2_mean, row.r2_deviation], [np.mean(scores), np.std(scores)], atol=2e-6)


def test_populations_are_measured(spark):
    from cadenza.operators import evaluation

    items = spark.createDataFrame([(k, "big" if k < 12 else "pair" if k < 14 else None if k < 16 else f"own{k}") for k in range(30)], "id long, key string")
    leaders, members = evaluation.large_groups(items, 10)
    assert [tuple(r) for r in leaders.collect()] == [(0, "big", 11)] and sorted(r.seed_id for r in members.collect()) == list(range(12))
    capped = evaluation.group_members(items, groups=5, most=3).collect()
    assert sorted((r.key, r.id, r["size"]) for r in capped) == [("big", 0, 12), ("big", 1, 12), ("big", 2, 12), ("pair", 12, 2), ("pair", 13, 2)]
    assert evaluation.large_groups(items, 12)[1].collect() == []
    assert evaluation.sampled_seeds(items, "s", 4).count() == 4 and evaluation.sampled_seeds(items, "s", 4).collect() == evaluation.sampled_seeds(items.repartition(3), "s", 4).collect()


def test_election_reads_its_rows_in_many_tasks(spark, monkeypatch):
    seen = []

    def elected(train, test, label, trees):
        seen.append((train.rdd.getNumPartitions(), train.count() + test.count(), train.inputFiles()[0]))
        return [{"features": "base", "mae": 1.0, "approved": True, "champion": True}]

    monkeypatch.setattr(recommendation.ml, "elected", elected)
    monkeypatch.setattr(recommendation, "ROWS_OF_A_FILE", 50, raising=False)
    assert recommendation.model_champion(spark, SMALL).count() == 1
    assert seen[0][0] >= 4 and seen[0][1] == recommendation.training(spark, SMALL).count() and "/part.parquet" not in seen[0][2]


def test_election_grows_all_trees_of_its_candidates(spark, monkeypatch):
    fitted, pipeline = [], recommendation.ml.pipeline

    def few(numeric, categories, label, linear=False, trees=20):
        fitted.append((len(numeric) + len(categories), trees))
        return pipeline(numeric, categories, label, linear, 1)

    monkeypatch.setattr(recommendation.ml, "pipeline", few)
    found = recommendation.model_champion(spark, SMALL).collect()
    assert [r.features for r in found] == ["base", "base+A", "base+B", "base+A+B"] and sum(r.champion for r in found) == 1
    assert sorted(fitted) == [(11, 100), (12, 100), (14, 100), (15, 100)]


class Calls:
    """The handle of a processor for one bucket; notes what is asked of the state."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked.append("get")
        return self.value

    def update(self, value):
        self.asked.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.asked.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired


def test_a_bucket_of_messages_asks_the_state_once(spark):
    pd = pytest.importorskip("pandas")
    calls = Calls()
    bucket = outbox.Delivery(lambda id_, payload, attempt: 1 / (0 if attempt <= id_ % 4 else 1), 5, 3)
    bucket.init(calls)

    def came(rows):
        frames = (pd.DataFrame(rows[k : k + 400], columns=["id", "payload", "now"]) for k in range(0, len(rows), 400))
        return [tuple(r) for f in bucket.handleInputRows((0,), frames, calls) for r in f[["id", "attempt", "now", "ok", "dead"]].itertuples(index=False)]

    def fire(now):
        calls.now, found = now, []
        for calls.fired in sorted(t for t in calls.timers if t <= now):
            found += [tuple(r) for f in bucket.handleExpiredTimer((0,), calls, calls) for r in f[["id", "attempt", "now", "ok", "dead"]].itertuples(index=False)]
            calls.timers.remove(calls.fired)
        return found

    rows = [(k, f"m{k}", 1000) for k in range(1000)] + [(5, "again", 1000), (outbox.CLOCK, "", 1000)]
    assert sorted(came(rows)) == [(k, 1, 1000, k % 4 == 0, False) for k in range(1000)]
    assert sorted(calls.asked) == ["get", "timer", "update"] and calls.timers == {6000}
    calls.asked.clear()
    # an earlier message moves the timer; one that comes again starts anew
    assert sorted(came([(1001, "early", 500), (3, "anew", 3000)])) == [(3, 1, 3000, False, False), (1001, 1, 500, False, False)] and calls.timers == {5500}
    assert fire(5499) == [] and fire(5500) == [(1001, 2, 5500, True, False)] and calls.timers == {6000}
    assert sorted(fire(6000)) == [(k, 2, 6000, k % 4 < 2, False) for k in range(1000) if k % 4 and k != 3] and calls.timers == {8000}
    assert fire(8000) == [(3, 2, 8000, False, False)] and calls.timers == {11000}
    assert sorted(fire(11000)) == [(k, 3, 11000, k % 4 == 2, k % 4 == 3) for k in range(1000) if k % 4 > 1 and k != 3] and calls.timers == {13000}
    assert fire(13000) == [(3, 3, 13000, False, True)] and calls.timers == set() and calls.value is None
