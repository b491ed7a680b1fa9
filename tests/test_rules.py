"""Golden rows, edges and invariants of the catalogue's rules."""

import hashlib
import struct
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import numeric, text
from cadenza.operators import cooccurrence, dataset, evaluation, insights, matching, paging, recommend, similarity
from cadenza.sources import catalog_csv, rest, sinks
from cadenza.streaming import outbox


def values(frame, column):
    return [r[column] for r in frame.collect()]


def test_match_keys(spark):
    rows = [
        ("  BOHEMIAN   RHAPSODY  ", "QUEEN", "queen|bohemian rhapsody"),
        ("Don't Stop Me Now", "Queen", "queen|dont stop me now"),
        ("Coração", "Queen", "queen|coracao"),
        ("X - Remastered 2011", "Queen;David Bowie;Outro", "queen|x"),
        ("Song (feat. Someone)", "Queen", "queen|song"),
        ("Song [Bonus (x [y]) Track] end", "Queen", "queen|song end"),
        (None, None, "|"),
        ("()", "[]", "|"),
        (" - x", "A", "a|x"),
    ]
    df = spark.createDataFrame([(t, a) for t, a, _ in rows], "t string, a string").select(text.match_key(F.col("t"), F.col("a")).alias("k"))
    assert values(df, "k") == [k for *_, k in rows]


def test_codes_and_dates(spark):
    good = ["BRBMG0300729", "USUM71703861", "GBAYE0601498", "BR-BMG-03-00729", "brbmg0300729", " BRBMG0300729 "]
    bad = [None, " ", "BRBMG030072", "BRBMG03007290", "B1BMG0300729", "BRBMG03007A9", "BRBM-0300729"]
    got = values(spark.createDataFrame([(x,) for x in good + bad], "x string").select(text.isrc(F.col("x")).alias("y")), "y")
    assert None not in got[: len(good)] and set(got[len(good) :]) == {None}
    dates = {"1975": (1975, "year"), "1975-11": (1975, "month"), "1975-11-21": (1975, "day"), "desconhecido": (None, None), "75": (None, None), "1975-02-31": (None, None), "0999": (None, None), None: (None, None)}
    y, p, _ = text.release_date(F.col("x"))
    got = [(r.y, r.p) for r in spark.createDataFrame([(k,) for k in dates], "x string").select(y.alias("y"), p.alias("p")).collect()]
    assert got == list(dates.values())


def test_credits_keep_the_first_spelling(spark):
    df = spark.createDataFrame([(" Queen; queen;;David Bowie ",), (None,), ("",)], "c string")
    assert values(df.select(text.split_credits(F.col("c")).alias("x")), "x") == [["Queen", "David Bowie"], None, []]


def fnv(seed, identifier):
    state = 14695981039346656037
    for byte in struct.pack("<i", seed) + identifier.encode():
        state = (state ^ byte) * 1099511628211 % 2**64
    return state % 1_000_000


@settings(max_examples=5, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1))
def test_seeded_bucket(spark, seed):
    ids = [f"id{k * 7919}" for k in range(200)] + ["", "0"]
    got = values(spark.createDataFrame([(i,) for i in ids], "i string").select(numeric.seeded_bucket(F.col("i"), seed).alias("b")), "b")
    assert got == [fnv(seed, i) for i in ids]


@pytest.mark.parametrize("rows, expected", [([], []), ([5.0, 5.0], [(5.0, 5.0, 2)]), ([0.0, 1.0, 2.0, 4.0, None], [(0.0, 2.0, 2), (2.0, 4.0, 2)])])
def test_histogram_edges(spark, rows, expected):
    df = spark.createDataFrame([(v, False) for v in rows], "value double, flag boolean")
    got = insights.histogram(df, "value", "flag", buckets=2).orderBy("bucket").collect()
    assert [(r.lower_bound, r.upper_bound, r["count"]) for r in got] == expected


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, 4.0, None)], "x double, y double, z double")
    got = {r.feature: (r.sample_size, r.correlation) for r in insights.correlations(df, ["x", "z"], "y").collect()}
    assert got == {"x": (3, None), "z": (2, 1.0)}


@pytest.mark.parametrize("energy, expected", [([0.1, 0.7, 0.3], 0.3), ([0.2, 0.4], 0.3), ([0.3, 0.4, 0.5, 100.0], 0.45), ([0.8, None, 0.8], 0.8)])
def test_medians(spark, energy, expected):
    df = spark.createDataFrame([(" Rock ", e) for e in energy], "genre string, energy double")
    got = {r.genre: r.energy for r in matching.medians(df, "genre", ["energy"]).collect()}
    assert got["rock"] == pytest.approx(expected) and got[None] == pytest.approx(expected)


def test_imputation_falls_back_and_rounds_away_from_zero(spark):
    df = spark.createDataFrame([("a", "rock", 2), ("b", "rock", 3), ("c", "rock", None), ("d", "jazz", None), ("e", None, None)], "id string, genre string, key int")
    got = {r.id: (r.key, r.is_imputed) for r in matching.impute(df, "genre", [], ["key"]).collect()}
    assert got == {"a": (2.0, False), "b": (3.0, False), "c": (3.0, True), "d": (3.0, True), "e": (3.0, True)}


VECTORS = {"seed": (0.80, 0.80, 120.0), "near": (0.79, 0.81, 122.0), "mid": (0.55, 0.55, 110.0), "far": (0.10, 0.10, 60.0)}


def small_index(spark):
    rows = [(k, list(v), "rock" if k != 2 else "jazz", k == 9, 10 * k, f"w{k}") for k, v in enumerate(VECTORS.values())]
    return similarity.index_of(spark.createDataFrame(rows, "id long, vector array<double>, genre string, is_imputed boolean, popularity long, key string"), "vector", 3)


def test_neighbours_leave_out_the_seed_and_boost_its_genre(spark):
    index = small_index(spark)
    seed = index.where("id = 0")
    plain = similarity.neighbours(seed, index, 10).orderBy("rank").collect()
    assert [r.id for r in plain] == [1, 2, 3]
    same = similarity.neighbours(seed, index, 10, "same_genre").collect()
    assert {r.id for r in same} == {1, 3}
    boosted = {r.id: r.score - r.cosine for r in similarity.neighbours(seed, index, 10, "boost").collect()}
    assert boosted[1] == pytest.approx(0.05) and boosted[2] == 0
    unlabelled = similarity.neighbours(seed.withColumn("genre", F.lit(" ")), index, 10, "same_genre").collect()
    assert len(unlabelled) == 3 and all(r.fell_back for r in unlabelled)


def test_contributions_add_up(spark):
    index = small_index(spark)
    row = similarity.neighbours(index.where("id = 0"), index, 1).withColumn("why", similarity.contributions(3)).first()
    assert sum(x.share for x in row.why) == pytest.approx(row.cosine, abs=1e-8)
    with pytest.raises(ValueError):
        similarity.contributions(10)


def test_collapse_keeps_first_position_and_best_representative(spark):
    rows = [(0, 1, 1, 0.9, "a", 5, True, [1.0, 0.0]), (0, 2, 2, 0.8, "b", 5, False, [0.0, 1.0]), (0, 3, 3, 0.7, "a", 5, False, [0.5, 0.5]), (0, 4, 4, 0.6, "c", 9, False, [0.0, 2.0])]
    ranked = spark.createDataFrame(rows, "seed_id long, id long, rank long, score double, key string, popularity long, is_imputed boolean, unit array<double>")
    got = [(r.position, r.id, r.score, r.collapsed) for r in recommend.collapse(ranked, 10).orderBy("position").collect()]
    assert got == [(1, 3, 0.7, 1), (2, 4, 0.6, 1)]
    assert recommend.collapse(ranked, 1).collect()[0].id == 1  # the scan ends when the last group opens


def test_blend(spark):
    content = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5)], "seed_id long, id long, score double")
    shared = spark.createDataFrame([(0, 2, 3, 0.5), (0, 7, 2, 1.0), (0, 0, 9, 1.0)], "seed_id long, id long, co_count long, jaccard double")
    got = {r.id: (r.score, r.signal) for r in recommend.blend(content, shared).collect()}
    assert got == {1: (0.65, None), 2: (0.175, "blended"), 7: (0.35, "collaborative")}
    with pytest.raises(ValueError):
        recommend.blend(content, shared, 1.5)


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 33.0)], "y double, p double")
    row = dataset.regression_metrics(df, "y", "p").first()
    assert (row.mae, row.rmse) == (pytest.approx(7 / 3, abs=1e-6), pytest.approx((17 / 3) ** 0.5, abs=1e-6))
    assert dataset.regression_metrics(df, "y", "y").first().r2 == 1
    assert dataset.regression_metrics(df.withColumn("p", F.lit(20.0)), "y", "p").first().r2 == 0
    assert dataset.regression_metrics(df.where("false"), "y", "p").count() == 0


def test_gates():
    assert dataset.passes_gate(95, 100) and not dataset.passes_gate(96, 100)
    assert dataset.promoted(90, 100, None) and not dataset.promoted(90, 100, 89)
    approved = dataset.approved_blocks(15.168, {"A": 15.1862, "B": 11.5396})
    assert approved == ["B"]
    maes = {(): 15.168, ("A",): 15.1862, ("B",): 11.5396, ("A", "B"): 11.5076}
    assert set(dataset.block_sets(["A", "B"])) == set(maes) and dataset.champion(maes, approved) == ("B",)
    good = {"coherence": 0.5, "lift": 4.0, "saturation_most": 0.3, "recall": 0.6, "hit_rate": 0.7, "sibling_cosine": 0.99, "self_hits_most": 0, "short_most": 0, "redundant_most": 0, "single_most": 0}
    assert evaluation.gate(good) == [] and evaluation.gate(good | {"lift": 1.0}) == ["lift"]
    with pytest.raises(ValueError):
        evaluation.gate({})
    with pytest.raises(ValueError):
        dataset.checked_input("a", {"energy": 1})
    whole = {n: (low + top) / 2 for n, (low, top) in dataset.RANGES.items() if n not in dataset.DEFAULTS}
    given = dataset.checked_input(features=whole)[1]
    assert given == whole | {"key": 0, "mode": 0, "time_signature": 4, "explicit": False, "genre": None}
    for bad in ({"energy": 1.2}, {"energi": 0.5}, {"tempo": None}, {"key": 12}):
        with pytest.raises(ValueError):
            dataset.checked_input(features=whole | bad)
    with pytest.raises(ValueError):
        dataset.checked_input(features={"tempo": 120})


def test_gate_refuses_what_does_not_fit():
    m = evaluation.Measurement
    good = {"mean": 0.5, "saturation": 0.1, "self_hits": 0, "recall": 0.6, "hit_rate": 0.7, "sibling_cosine": 0.99, "redundant": 0, "seeds_evaluated": 9, "short": 0.0, "single": 0}
    parts = {
        "plain": m(good | {"mean": 0.2}, "sample", "off"), "boosted": m(good, "sample"), "engine": m(good, "sample", "off"),
        "deduped": m(good, evaluation.LEADERS, dedupe=True), "lengths": m(good, evaluation.MEMBERS),
    }
    assert evaluation.judged(**parts) == []
    assert evaluation.judged(**parts | {"plain": m(good, "sample", "off")}) == ["lift"]
    assert evaluation.judged(**parts | {"plain": m(good | {"mean": 0}, "sample", "off"), "lengths": m(good | {"single": 1, "short": 0.06}, evaluation.MEMBERS)}) == ["short_most", "single_most"]
    for odd in (
        {"boosted": m(good, "sample", strategy="blend")}, {"plain": m(good, "sample", "off", dedupe=True)}, {"plain": m(good, None, "off")}, {"plain": m(good, "other", "off")}, {"engine": m(good, "sample", "off", dedupe=True)},
        {"deduped": m(good, evaluation.LEADERS)}, {"deduped": m(good, "sample", dedupe=True)}, {"deduped": m(good | {"seeds_evaluated": 0}, evaluation.LEADERS, dedupe=True)}, {"lengths": m(good, evaluation.MEMBERS, top_n=5)}, {"lengths": m(good, "sample")},
    ):
        with pytest.raises(ValueError):
            evaluation.judged(**parts | odd)


def test_list_sizes_of_a_population(spark):
    seeds = spark.createDataFrame([(k,) for k in range(4)], "seed_id long")
    lists = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 2)], "seed_id long, id long")
    row = evaluation.sizes(lists, seeds, 2).first()
    assert (row.seeds_evaluated, row.short, row.single) == (4, 0.75, 2) and evaluation.self_hits(lists).first().self_hits == 2


def test_match_chain_order_of_rules(spark):
    tracks = spark.createDataFrame([(1, "a|x", 1000), (2, "a|x", 5000), (3, "b|y", 100)], "id long, match_key string, duration_ms long")
    rows = spark.createDataFrame([(10, 3, "a|x", 1000), (11, None, "a|x", 4000), (12, None, "a|x", 90000), (13, 99, "c|z", 1), (14, None, "a|x", 3000)], "row_id long, external_id long, match_key string, duration_ms long")
    got = {r.row_id: (r.track_id, r.match_kind) for r in matching.match_chain(rows, tracks).collect()}
    assert got == {10: (3, "id"), 11: (2, "key_duration"), 12: (1, "key"), 13: (None, "none"), 14: (1, "key_duration")}


def test_pages_make_the_whole(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    got = [r.k for p in paging.pages(df, [F.asc("k")], 20) for r in p.collect()]
    assert got == list(range(45))
    assert paging.page_of(df, [F.asc("k")], page=9, total="n").collect() == []
    assert paging.clamped(0, 999) == (1, 200)
    with pytest.raises(ValueError):
        paging.sort_columns({"a": []}, "b")


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "p.csv").write_text('"user_id", "artistname", "trackname", "playlistname"\n"u1","Q","She said \\"yes\\"","mine"\n"u2","Q","next","mine"\n"","Q","lost","mine"\n')
    got = catalog_csv.read_playlists(spark, f"file://{tmp_path}/p.csv").orderBy("user_id").collect()
    assert [(r.user_id, r.track) for r in got] == [("u1", 'She said "yes"'), ("u2", "next")]
    names = ",".join(["", *[f.split()[0] for f in catalog_csv.CATALOG.split(", ")][1:]])
    (tmp_path / "c.csv").write_text(names + '\n0,abc123,"A;B",Some Album,Some Song,73,201000,,0.5,oops,5,-6.0,1,0.05,0.1,0.0,0.2,0.4,120.0,4, pop \n')
    row = catalog_csv.read_catalog(spark, f"file://{tmp_path}/c.csv").first()
    assert (row.track_id, row.artists, row.energy, row.explicit, row.track_genre, row.time_signature) == ("abc123", "A;B", None, False, "pop", 4)


def test_retry_waits_and_gives_up():
    answers, waits = [(429, {"Retry-After": "2"}, None), (503, {}, None), (200, {}, "ok")], []
    assert rest.with_retry(lambda: answers.pop(0), sleep=waits.append) == "ok" and waits == [2.0, 1.0]
    with pytest.raises(RuntimeError):
        rest.with_retry(lambda: (404, {}, None), sleep=waits.append)
    assert list(rest.all_pages(lambda o, n: (200, {}, {"total": 3, "items": [o, None] if o < 3 else []}), 2)) == [0, 2]
    busy = [(429, {}, None), (200, {}, {"total": 9, "items": [1]}), (200, {}, {"total": 9, "items": []})]
    assert list(rest.all_pages(lambda o, n: busy.pop(0), sleep=waits.append)) == [1]  # an empty page ends it before the total
    asked = []
    assert list(rest.in_batches(["a", "b", "c"], lambda ids: asked.append(ids) or (200, {}, [x if x != "b" else None for x in ids]), 2)) == ["a", "c"] and asked == [["a", "b"], ["c"]]


def flaky(offset, size, options):
    """Every page is refused once, so its reader has to ask again; the last page is empty though the total says more."""
    import pathlib

    seen = pathlib.Path(options["folder"], f"{offset}")
    if not seen.exists():
        seen.touch()
        return 503, {"Retry-After": "0"}, None
    return 200, {}, {"total": 12, "items": [{"id": k, "name": f"n{k}", "more": k * 2} if k != 5 else None for k in range(offset, min(offset + size, 10))]}


def test_paged_source_retries_and_reads_the_body(spark, tmp_path):
    options = {"transport": "tests.test_rules:flaky", "size": 2, "tasks": 3, "folder": str(tmp_path)}
    got = rest.read_pages(spark, "id long, more long", **options).collect()
    assert sorted((r.id, r.more) for r in got) == [(k, 2 * k) for k in range(10) if k != 5]
    gone = rest.read_pages(spark, transport="tests.test_rules:missing")
    with pytest.raises(Exception, match="404"):
        gone.collect()


def missing(offset, size, options):
    return 404, {}, None


def test_look_up_in_batches(spark):
    ids = spark.createDataFrame([(k % 30,) for k in range(90)] + [(None,)], "k long")

    def service(part):
        assert len(part) <= 7
        return 200, {}, [{"id": k, "extra": 1} if k % 3 else None for k in part]

    found = rest.look_up(ids, "k", service, StructType().add("id", "long"), size=7).collect()
    assert sorted(r.id for r in found) == [k for k in range(30) if k % 3]
    assert rest.look_up(ids.where("false"), "k", service, StructType().add("id", "long")).collect() == []


def test_failing_ticks_are_not_fatal():
    stop, ran = threading.Event(), []

    def tick():
        ran.append(1)
        if len(ran) == 3:
            stop.set()
        if len(ran) < 3:
            raise RuntimeError("down")

    assert outbox.timed("test", tick, 0.01, stop) == 2 and len(ran) == 3


def test_append_is_idempotent(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.range(5).withColumn("v", F.col("id") * 2)
    for _ in range(2):
        sinks.append_new(df, path, "id")
    sinks.append_new(spark.range(8).withColumn("v", F.lit(0).cast("long")), path, "id")
    assert spark.read.parquet(path).count() == 8


def test_outbox_stream_counts_attempts_and_buries(spark, tmp_path):
    log = spark.createDataFrame([(k, f"2024-01-0{k + 1} 00:00:00", None, 4 if k == 2 else 0, None) for k in range(4)], "id long, at string, processed_at timestamp_ntz, attempts int, dead_lettered_at timestamp_ntz")
    log = log.withColumn("occurred_at", F.col("at").cast("timestamp_ntz")).drop("at")
    outcome = spark.createDataFrame([(0, True), (2, False)], "id long, ok boolean")
    got = {r.id: (r.processed_at is not None, r.attempts, r.dead_lettered_at is not None) for r in outbox.after_tick(log, outcome, "2030-01-01 00:00:00", batch=3).collect()}
    assert got == {0: (True, 0, False), 1: (False, 1, False), 2: (False, 5, True)}
    source, seen = f"file://{tmp_path}/log", []
    log.write.parquet(source)
    schema = log.schema.simpleString()[7:-1].replace(":", " ")
    outbox.dispatch(spark, source, schema, lambda batch, number: seen.extend(r.id for r in batch.collect()), f"file://{tmp_path}/cp").awaitTermination(60)
    outbox.dispatch(spark, source, schema, lambda batch, number: seen.extend(r.id for r in batch.collect()), f"file://{tmp_path}/cp").awaitTermination(60)
    assert sorted(seen) == [0, 1, 2, 3]


def test_ingest_counters(spark):
    batch = spark.createDataFrame([("a",), ("a",), ("b",), (" ",), (None,)], "k string")
    row = outbox.ingest_counters(batch, spark.createDataFrame([("b",)], "k string"), "k").first()
    assert (row.ingested, row.updated, row.duplicates, row.skipped) == (1, 1, 1, 2)


def test_jobs_from_files_to_cooccurrence(spark, tmp_path):
    from cadenza import jobs

    names = ",".join(["", *[f.split()[0] for f in catalog_csv.CATALOG.split(", ")][1:]])
    row = '{n},t{n},"Queen;Other",Album,Song {n},73,201000,False,0.5,0.6,5,-6.0,1,0.05,0.1,0.0,0.2,0.4,120.0,4,pop'
    (tmp_path / "c.csv").write_text("\n".join([names, *(row.format(n=n) for n in (1, 2, 2, 3))]) + "\n")
    lists = [(u, n) for u in "abc" for n in (1, 2)] + [("a", 9)]
    (tmp_path / "p.csv").write_text('"user_id", "artistname", "trackname", "playlistname"\n' + "".join(f'"{u}","QUEEN","Song {n} - Live","mine"\n' for u, n in lists))
    at = lambda x: f"file://{tmp_path}/{x}"
    for _ in range(2):
        jobs.seed_catalog(spark, at("c.csv"), at("catalog"))
        jobs.seed_references(spark, at("catalog"), at("artists"))
        jobs.seed_playlists(spark, at("p.csv"), at("catalog"), at("playlists"))
        jobs.build_cooccurrence(spark, at("playlists"), at("edges"))
    assert [spark.read.parquet(at(x)).count() for x in ("catalog", "artists", "playlists")] == [3, 2, 3]
    edges = spark.read.parquet(at("edges")).collect()
    assert [(e.low, e.high, e.co_count, e.jaccard) for e in edges] == [("t1", "t2", 3, 1.0)]


def test_model_versions(spark, tmp_path):
    from cadenza.operators import ml

    path = f"file://{tmp_path}/m"
    rows = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3 + 1).cast("double").alias("y"))
    model = ml.pipeline(["x"], [], "y", linear=True).fit(rows)
    assert sinks.current(spark, path) is None
    first = sinks.save_model(spark, model, path, {"mae": 0.5}, baseline_mae=1.0)
    other = sinks.save_model(spark, ml.pipeline(["x"], [], "y", trees=1).fit(rows), path, {"mae": 0.6}, baseline_mae=1.0)
    third = sinks.save_model(spark, model, path, {"mae": 0.4}, baseline_mae=0.41)
    rows_of = {r.version: r for r in sinks.versions(spark, path).collect()}
    assert [rows_of[v].sequence for v in (first, other, third)] == [1, 2, 3] and rows_of[first].digest != rows_of[other].digest
    files = sorted(hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / "m/artifacts" / first).rglob("*") if f.is_file() and not f.name.startswith((".", "_")))
    assert rows_of[first].digest == hashlib.sha256(",".join(files).encode()).hexdigest()
    assert sinks.promote(spark, path, first) and sinks.current(spark, path).version == first
    assert not sinks.promote(spark, path, other)  # worse than the present one
    assert not sinks.promote(spark, path, third)  # hardly better than its baseline
    assert [r.version for r in sinks.versions(spark, path).where("is_current").collect()] == [first]
    with pytest.raises(ValueError):
        sinks.promote(spark, path, "none")
    assert dataset.regression_metrics(ml.scored(model, rows), "y", "prediction").first().mae < 0.01


def test_scoring_warns(spark):
    from cadenza.operators import ml

    rows = spark.range(60).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 - 20).alias("y"), F.when(F.col("id") != 5, F.col("id") % 2 == 1).alias("is_imputed"))
    got = {r.id: r for r in ml.scored(ml.pipeline(["x"], [], "y", linear=True).fit(rows), rows).collect()}
    assert got[10].warnings == [] and got[11].warnings == ["imputed_features"] and got[5].warnings == ["clamped_output"] and got[59].warnings == ["imputed_features", "clamped_output"]
    assert got[0].prediction == 0 and got[0].raw_score == pytest.approx(-20, abs=1e-6) and got[10].prediction == pytest.approx(10, abs=1e-6)


def test_linear_model_and_importance_equal_least_squares(spark):
    from cadenza.operators import ml

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) * 0.1
    rows = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    model = ml.pipeline(["a", "b"], [], "y", linear=True).fit(rows)
    full = np.column_stack([x, np.ones(400)])
    fitted = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    mine = np.array([r.prediction for r in model.transform(rows).orderBy("id").collect()])
    assert np.abs(mine - fitted).max() < 1e-6
    found = {r.feature: r for r in dataset.importance_rollup(ml.permutation_importance(model, rows, ["a", "b"], "y", "id", buckets=1)).collect()}
    # a column in another order adds twice its coefficient's share of variance to the squared error
    for name, share in (("a", 9 * x[:, 0].var()), ("b", 0.25 * x[:, 1].var())):
        assert found[name].r2_drop == pytest.approx(2 * share / y.var(), rel=0.15) and found[name].r2_sd > 0 and found[name].mae_rise > 0
    mean, deviation = ml.cross_validated(rows, lambda: ml.pipeline(["a", "b"], [], "y", linear=True), "y", "id")
    assert mean > 0.99 and 0 < deviation < 0.01


def test_blocks_are_elected(spark):
    from cadenza.operators import ml

    rng = np.random.default_rng(5)
    names = [*ml.BASE, "mode", "key", "time_signature", "genre", "popularity", "id"]
    made = [(*map(float, rng.random(len(ml.BASE))), float(k % 2), k % 12, k % 3 + 3, ("rock", "pop", None)[k % 3], float(20 + 30 * (k % 3) + rng.normal()), k) for k in range(300)]
    rows = spark.createDataFrame(made, ", ".join([*(f"{c} double" for c in names[:12]), "key int, time_signature int, genre string, popularity double, id long"]))
    found = {r["features"]: r for r in ml.elected(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), "popularity", trees=2)}
    assert set(found) == {"base", "base+A", "base+B", "base+A+B"} and found["base+B"]["approved"]
    assert found["base+B"]["mae"] < 0.5 * found["base"]["mae"] and found["base"]["champion"] is False and sum(r["champion"] for r in found.values()) == 1


def test_repeated_ids_and_clamps(spark):
    index = small_index(spark)
    twice = index.withColumn("at", F.lit(1)).unionByName(index.where("id = 0").withColumn("popularity", F.lit(99).cast("long")).withColumn("at", F.lit(2)))
    assert [r.popularity for r in similarity.looked_up(twice, spark.createDataFrame([(0,), (0,)], "id long"), "at").collect()] == [99]
    seed = index.where("id = 0")
    assert [similarity.diagnostic(seed, index, n).count() for n in (0, 2, 1000)] == [1, 2, 3]


def test_blocks_of_seeds_and_index_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(0, 3, 3).astype(float).tolist(), "ab"[k % 2] if k % 7 else None, k % 5 == 0, k, "k") for k in range(150)]
    items = spark.createDataFrame(rows, "id long, vector array<double>, genre string, is_imputed boolean, popularity long, key string")
    index = similarity.index_of(items, "vector", 3)
    for mode in similarity.MODES:
        ranked = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("score"), F.asc("id")))
        plain = sorted(map(tuple, similarity.scored(index, index, mode).withColumn("rank", ranked).where("rank <= 8").select("seed_id", "id", "rank", "score", "cosine", "fell_back").collect()))
        for seeds, cells in ((10_000, 4_000_000), (40, 400)):
            monkeypatch.setattr(similarity, "MOST_SEEDS", seeds)
            monkeypatch.setattr(similarity, "CELLS", cells)
            assert sorted(map(tuple, similarity.neighbours(index, index, 8, mode).select("seed_id", "id", "rank", "score", "cosine", "fell_back").collect())) == plain


def test_large_baskets_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(int(b), int(i)) for b in range(12) for i in rng.choice(60, 5 + 4 * b)], "basket long, item long")
    whole = sorted(map(tuple, cooccurrence.matrix(rows).collect()))
    seeds = spark.createDataFrame([(3,), (4,), (999,)], "seed long")
    assert sorted(map(tuple, cooccurrence.seed_edges(rows, seeds).collect())) == sorted(map(tuple, cooccurrence.of_seeds(cooccurrence.matrix(rows), seeds).collect()))
    monkeypatch.setattr(cooccurrence, "PART", 6)
    assert sorted(map(tuple, cooccurrence.matrix(rows).collect())) == whole and whole


def test_recommendation_explains_and_warns(spark):
    rows = [(0, [1.0, 0.2, 0.0], "rock", True, 10, "a"), (1, [0.9, 0.2, 0.0], "rock", False, 20, "b"), (2, [0.9, 0.2, 0.01], "rock", True, 30, "b"), (3, [0.0, 1.0, 0.3], "jazz", False, 5, "c"), (4, [0.1, 0.1, 1.0], None, False, 5, "d")]
    index = similarity.index_of(spark.createDataFrame(rows, "id long, vector array<double>, genre string, is_imputed boolean, popularity long, key string"), "vector", 3)
    seeds = index.where("id IN (0, 1, 4)")
    edges = spark.createDataFrame([(1, 3, 4, 0.9), (1, 77, 2, 0.5)], "seed_id long, id long, co_count long, jaccard double")
    got = {}
    for r in recommend.recommend(seeds, index, 3, edges=edges).collect():
        got.setdefault(r.seed_id, {})[r.id] = r
    assert got[0][2].warnings == ["seed_imputed", "genre_fallback", "no_collaborative", "imputed_items"] and got[0][2].collapsed == 1
    assert got[1][3].signal == "blended" and got[1][3].co_count == 4 and len(got[1][3].reasons) == 3
    unheard = {r.id: r for r in recommend.recommend(seeds, index, 5, edges=edges).where("seed_id = 1").collect()}[77]
    assert (unheard.signal, unheard.cosine, unheard.reasons, unheard.is_imputed, unheard.shared_genre) == ("collaborative", 0, [], False, None)
    assert all("genre_fallback" in r.warnings and r.shared_genre is None for r in got[4].values()) and all("no_collaborative" not in r.warnings for r in got[1].values())
    plain = recommend.recommend(index.where("id = 1"), index, 5, "off").collect()
    assert all(r.genre_boost == 0 and r.signal is None and r.score == r.cosine for r in plain) and {r.id for r in plain} & {2} == {2}
    assert next(r for r in plain if r.id == 2).shared_genre == "rock"
