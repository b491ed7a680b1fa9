"""Operators over whole tables: archives, url filters, near duplicates, fingerprints, the pipeline."""

import random
import re
import time
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import bloom, chroma, common, components, decontaminate, near_dedup, oracles, quality, registry, url_filter, warc
from tests.comparing import assert_same
from tests.conftest import SMALL
from tests.llm.test_text_operators import brute_spans


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_equals_sql(spark, duck, name):
    assert_same(registry.queries()[name](spark, SMALL), duck, oracles.SQL[name])


def test_a_cluster_must_name_its_shared_folder():
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y/"), sparkContext=SimpleNamespace(master="spark://a:1"))
    assert common.shared_dir(there) == "hdfs://x/y"
    without = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1000]"))
    with pytest.raises(ValueError):
        common.shared_dir(without)


# -- 3


def test_archives_hold_what_was_written(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/ c\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "z" * 200_000), (2, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(5)).withColumn("archive", F.lit("x"))
    got = warc.roundtrip(df).collect()
    found = sorted((r.page_id is None, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert found == sorted([(False, 1, "revisit", 2, 1203), (False, 2, "response", None, 1203), (False, 2, "response", None, 1203), (True, None, "revisit", 2, 1203), (False, 3, "response", None, 5), (False, 4, "response", None, 5), (False, 5, "response", None, 0), (False, 6, "response", None, 0), (False, 7, "response", None, 999), (False, 8, "response", None, 999), (False, 9, "response", None, 200_000)], key=lambda x: (x[0], x[1] or 0, x[2]))
    assert warc.roundtrip(df.where("false")).collect() == []


def test_archive_format(tmp_path):
    records = [warc.record(k, f"http://a/{k}", "<html>" + "common words of pages " * 20 + str(k), "00" * 20, 5, None, "2024-01-01T00:00:00Z") for k in range(50)]
    with open(tmp_path / "a.zst", "wb") as out:
        warc.write_archive(out, records, 4096, 1 << 20, 3)
    raw = (tmp_path / "a.zst").read_bytes()
    assert raw[:4] == bytes.fromhex("5d2a4d18")
    assert raw.count(bytes.fromhex("28b52ffd")) >= 50  # a frame for each record
    with open(tmp_path / "a.zst", "rb") as file:
        assert list(warc.read_archive(file)) == records
    with open(tmp_path / "cut.zst", "wb") as out:
        out.write(raw[:-3])
    with open(tmp_path / "cut.zst", "rb") as file, pytest.raises(ValueError):
        list(warc.read_archive(file))


@pytest.mark.parametrize("records", [[b"x"], [b"one record only " * 300], [b"a%d" % k for k in range(5)], [bytes(range(256)) * 2000 + b"%d" % k for k in range(3)], [b"<p>%d</p>" % (k * k) * 40000 for k in range(12)]])
def test_every_archive_has_a_dictionary(tmp_path, records):
    with open(tmp_path / "a.zst", "wb") as out:
        warc.write_archive(out, records, 4096, 1 << 20, 3)
    raw = (tmp_path / "a.zst").read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == bytes.fromhex("5d2a4d18") and 0 < size <= 4096
    with open(tmp_path / "a.zst", "rb") as file:
        assert list(warc.read_archive(file)) == records


# -- 4


def plain_verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    verdict = ("block" if best[1] else "allow") if best else "block" if host in listed else "allow"
    return host, path, best[2] if best else None, verdict


def test_verdicts_equal_plain_matching(spark):
    rules = [*registry.RULES, ("block", "example.com", "/de/x"), ("allow", "example.com", "/de/x"), ("allow", "a.example.com", "")]
    urls = [None, "", "nourl", "http://", "http://NET/", "http://net", "http://x.net/a?b#c", "https://www.Example.net/en/1", "http://example.com/de/", "http://xexample.com/de/", "http://sub.example.com/de/x/1", "ftp://a.b.c.org/fr/é", "http://org/fr/", "http://.net/", "http://a.example.com?x", "http://u@net:80/", "a://b://c", "http://bad.host/", "http://bad.host/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("key", F.lit(1))
    got = url_filter.judge(df, rules, spark.createDataFrame([("bad.host",), ("unseen",)], "host string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [plain_verdict(u, rules, {"bad.host"}) for u in urls]
    assert url_filter.judge(df.where("false"), rules, spark.createDataFrame([], "host string")).collect() == []


@pytest.mark.parametrize("bits", [bloom.PART_BITS, 500])
def test_cascade_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(bloom, "PART_BITS", bits)  # 500: keys are dealt to several arrays
    monkeypatch.setattr(bloom, "FALSE_RATE", 0.3)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([("unseen",)], "key string"))
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 2 and (cascade.levels[0].parts > 1) == (bits == 500)
    marked = universe.where(cascade.has(F.col("key")))
    assert {r.key for r in marked.collect()} == {f"k{k}" for k in range(0, 3000, 7)}
    assert "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_has_levels_and_may_be_saved(spark, tmp_path):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".example/p")).alias("url"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    listed = hosts.where(F.md5("host") < "6")
    built = url_filter.Filter.build(pages, registry.RULES, listed)
    assert len(built.cascade.levels) >= 4
    built.cascade.save(f"file://{tmp_path}/cascade")
    again = url_filter.Filter(registry.RULES, url_filter.Cascade.load(spark, f"file://{tmp_path}/cascade"))
    part = pages.where("page_id % 3 = 0")
    wanted = sorted(map(repr, built.judge(part).collect()))
    assert sorted(map(repr, again.judge(part).collect())) == wanted and "Join" not in again.judge(part)._jdf.queryExecution().optimizedPlan().toString()
    known = {r.host for r in listed.collect()}
    assert all((r.verdict == "block") == (r.host in known) for r in again.judge(pages).where("rule IS NULL").collect())


def test_parts_of_a_large_filter_are_small(spark):
    level = bloom.Level(0, spark.createDataFrame([("a",)], "key string"), 1)
    for count in (10_000_000, 1_000_000_000):  # the arithmetic alone
        wanted = -count * np.log(0.25) / np.log(2) ** 2
        parts = max(1, int(np.ceil(wanted / bloom.PART_BITS)))
        assert wanted / parts / 8 <= 8 << 20
    assert level.parts == 1 and bloom.PART_BITS // 8 <= 8 << 20


# -- 9


def plain_groups(texts, words_each):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(words_each, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return [len(s) for s in sets], root


def copies(rng, n, vocabulary=300):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("small_node", [300, 8])
def test_groups_equal_all_pairs(spark, monkeypatch, small_node):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", small_node)
    rng = random.Random(small_node)
    rows = [None, "", "  ", "one", "ONE", "one two", "a b c d e", "a b c d e f"] + copies(rng, 60) + [t for _ in range(25) for t in copies(rng, 4)] + [f"alone {k} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(20)) for k in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").withColumn("label", F.lit("x")).withColumn("node", F.lit(1))
    got = near_dedup.groups(df, words_each=4).orderBy("id").collect()
    sizes, roots = plain_groups(rows, 4)
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == roots


def test_groups_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (8, None), (None, "only here with no id at all")], "id long, text string")
    got = sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id) for r in near_dedup.groups(df).collect())
    assert got == [(False, 3, 2, 3), (False, 5, 2, 3), (False, 5, 2, 3), (False, 8, 0, 8), (True, 0, 0, None), (True, 0, 2, 3), (True, 0, 3, None)]
    assert near_dedup.groups(df.where("false")).collect() == []


def test_groups_are_of_rows_not_of_ids(spark):
    """A row is grouped by its own text, whatever other texts its id has; rows without an id may link others."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    near, far = list(base), list(base)
    near[0], far[0], far[89] = "x", "x", "y"
    other = " ".join(f"q{k}" for k in range(50))
    t, u, v = " ".join(base), " ".join(near), other
    rows = [(3, t), (7, u), (7, v), (11, v), (None, u), (20, "z " + t[: len(t) // 9])]
    got = sorted(((r.id is None, r.id or 0, r.component_id) for r in near_dedup.groups(spark.createDataFrame(rows, "id long, text string"), 4).collect()), key=repr)
    assert got == sorted([(False, 3, 3), (False, 7, 3), (False, 7, 7), (False, 11, 7), (True, 0, 3), (False, 20, 20)], key=repr)


def test_slices_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 10)
    rng = random.Random(5)
    rows = [(k, c, rng.choice([1, 1, 1, 1, 2, 3, 100 + c])) for k in (1, 2) for c in range(60)]
    rows = [(k, c, label if k == 1 else (5 if c % 2 else 6)) for k, c, label in rows]
    met = near_dedup.sliced(spark.createDataFrame(rows, "node long, cid long, label long")).collect()
    parts = {}
    for r in met:
        parts.setdefault(r.node, []).append((r.cid, r.label))
    together = {(a, b) for part in parts.values() for a, _ in part for b, _ in part if a < b}
    for node in (1, 2):
        own = {c: label for k, c, label in rows if k == node}
        assert {(a, b) for a in own for b in own if a < b and own[a] != own[b]} <= together
    assert max(map(len, parts.values())) <= 3 * near_dedup.SMALL_NODE
    assert sum(map(len, parts.values())) < 120 * 12


def test_large_groups_of_near_copies_do_not_branch_on(spark, monkeypatch):
    """Rows in trees grow with a group of near copies, not faster, and all its pairs of different components meet."""
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 20)
    real, made = near_dedup.materialize, []

    def counted(df, name):
        out = real(df, name)
        made.extend([out.count()] if name == "nodes" and "cid" in out.columns else [])
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    rng = np.random.default_rng(6)
    rows = {}
    for n in (200, 800):  # a half is one component; the others have fewer places of the signature in common with it
        base = rng.integers(0, 2**32, near_dedup.PLACES)
        share = np.where(np.arange(n) % 2, 0.1, 0.25)[:, None]
        signs = np.where(rng.random((n, near_dedup.PLACES)) < share, rng.integers(0, 2**32, (n, near_dedup.PLACES)), base).astype(np.uint32)
        classes = spark.createDataFrame([(c, -1 if c % 2 else c, s.tobytes()) for c, s in enumerate(signs)], "cid long, label long, signature binary")
        made.clear()
        leaves, parts = near_dedup.tree_leaves(classes, 0, near_dedup.TREES)[0].collect(), {}
        rows[n] = sum(made)
        for r in leaves:
            parts.setdefault(r.node, set()).add(r.cid)
        met = np.zeros((n, n), bool)
        for part in parts.values():
            met[np.ix_(list(part), list(part))] = True
        other = np.arange(n)[:, None] % 2 * (np.arange(n) % 2) == 0
        assert met[other].all()
        assert len(leaves) < 30 * n and max(map(len, parts.values())) <= 4 * max(near_dedup.SMALL_NODE, n / near_dedup.SLICES)
        assert rows[n] < 2 * near_dedup.BRANCHES * near_dedup.TREES * n
    assert rows[800] < 5 * rows[200]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(100 + k, 100 + rng.randrange(30)) for k in range(30)] + [(7, 7), (200, 300)]
    root = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)])
    hits = [(near_dedup.signature_of(near_dedup.mixed(a + np.uint64(s))) == near_dedup.signature_of(near_dedup.mixed(b + np.uint64(s)))).mean() for s in range(20)]
    assert abs(np.mean(hits) - 2400 / 3600) < 0.03


# -- 2


def tones(notes, seed=None):
    at = np.arange(chroma.HOP) / chroma.RATE
    sound = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * at) for n in notes]) * 15000
    if seed is not None:
        sound = sound + np.random.default_rng(seed).normal(0, 300, len(sound))
    return sound.clip(-32768, 32767).astype("<i2").tobytes()


def test_alignment_finds_shifted_and_noisy_recordings(spark):
    rng = random.Random(2)
    song, other = [rng.randrange(24) for _ in range(90)], [rng.randrange(24) for _ in range(90)]
    rows = [(0, tones(song)), (1, tones(song)), (2, tones(song[20:])), (3, tones(song, 1)), (4, tones(other)), (5, None), (6, b""), (7, b"\0" * 9), (8, tones(song[:2]))]
    df = spark.createDataFrame(rows, "rec long, audio binary")
    prints = chroma.with_fingerprints(df.withColumns({c: F.lit("x") for c in ("fingerprint", "class_id", "__audio")}), "audio", "rec")
    members, links = (x.collect() for x in chroma.align(prints, F.col("rec") == 0, "rec"))
    classes, found = {r.rec: r for r in members}, {(r.class_id, r.query_id): r for r in links}
    assert classes[0].class_id == classes[1].class_id == 0 and len(members) == len(rows)
    assert {k: x.offset for k, x in found.items()} == {(2, 0): -20, (3, 0): 0}
    assert found[2, 0].bit_error_rate < 0.1
    assert {classes[k].class_id for k in (5, 6, 7, 8)} == {5} and classes[5].n_frames == 0
    assert all(x.collect() == [] for x in chroma.align(prints.where("false"), F.col("rec") == 0, "rec"))


def plain_links(prints, queries, most_errors=0.2, least_overlap=chroma.SPAN):
    """class, query: (offset, error rate), by plain histograms over all pairs of different fingerprints."""
    groups = {}
    for k, own in sorted(prints.items()):
        groups.setdefault(tuple(own), []).append(k)
    asked = [min(ks) for code, ks in groups.items() if code and any(k in queries for k in ks)]
    out = {}
    for code, ks in groups.items():
        for q in asked:
            if not code or q == min(ks):
                continue
            other, votes = prints[q], {}
            for i, x in enumerate(code):
                for j, y in enumerate(other):
                    if x == y and min(len(code) - max(0, i - j), len(other) + min(0, i - j)) >= least_overlap:
                        votes[i - j] = votes.get(i - j, 0) + 1
            rated = []
            for d in [d for d, n in votes.items() if n == max(votes.values())]:
                pairs = [(code[j + d], other[j]) for j in range(len(other)) if 0 <= j + d < len(code)]
                rated.append((sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in pairs) / (32 * len(pairs)), abs(d), d))
            if rated and min(rated)[0] <= most_errors:
                out[min(ks), q] = (min(rated)[2], min(rated)[0])
    return out


def test_links_equal_plain_histograms(spark):
    rng = random.Random(9)
    song = [rng.randrange(-9, 9) for _ in range(60)]
    rows = {k: [x if rng.random() < 0.7 else rng.randrange(-9, 9) for x in song[rng.randrange(8) :]] for k in range(1, 30)}
    rows |= {0: song, 30: [5] * 40, 31: [5] * 25, 32: [], 33: list(song), 34: song[:10]}
    df = spark.createDataFrame(list(rows.items()), "rec long, fingerprint array<int>")
    members, links = (x.collect() for x in chroma.align(df, F.col("rec") % 10 == 0, "rec"))
    wanted = plain_links(rows, {0, 10, 20, 30})
    assert {(r.class_id, r.query_id): (r.offset, pytest.approx(r.bit_error_rate)) for r in links} == wanted and len(wanted) > 20
    assert {r.rec: r.n_frames for r in members} == {k: len(x) for k, x in rows.items()}


def test_integral_image_equals_plain_sums():
    image = np.random.default_rng(3).random((40, 12))
    got = chroma.packed(image)
    for at in range(0, len(got), 7):
        code = 0
        for first, second in chroma.FILTERS:
            mean = [np.mean(np.concatenate([image[at + f : at + f + n, p : p + m].ravel() for f, p, n, m in areas])) for areas in (first, second)]
            level = int(np.searchsorted(chroma.CUTS, round(float(np.log((1 + mean[0]) / (1 + mean[1])) * 4), 9)))
            code = code << 2 | (level ^ level >> 1)
        assert int(got[at]) & 0xFFFFFFFF == code


def test_registered_search_equals_plain_histograms(spark):
    found = registry.op2_chroma(spark, SMALL).collect()
    prints = {2 * r.vec_id + r["take"]: list(r.fingerprint) for r in chroma.takes(spark.read.parquet(f"{SMALL}/embeddings.parquet"), "vec_id", "embedding").collect()}
    assert {r.recording: r.n_frames for r in found} == {k: len(x) for k, x in prints.items()}
    links = {(r.class_id, r.query_id): (r.offset, pytest.approx(r.bit_error_rate)) for r in found if r.query_id is not None}
    asked = {k for k in prints if k % 200 == 0}
    assert links == plain_links(prints, asked) and len(asked) > 1
    assert {q for _, q in links} == asked and all((q + 1, q) in links for q in asked)  # each query's second take is found
    assert {-chroma.LATE, 0} >= {o for (c, q), (o, _) in links.items() if c == q + 1}


@pytest.mark.parametrize("seed", range(3))
def test_runs_vote_as_their_places_do(spark, seed):
    rng = random.Random(seed)
    rows = {k: [c for _ in range(rng.randint(1, 6)) for c in [rng.choice([0, 0, 1, 2, 3])] * rng.randint(1, 9)] for k in range(40)}
    df = spark.createDataFrame(list(rows.items()), "rec long, fingerprint array<int>")
    links = chroma.align(df, F.col("rec") % 10 == 0, "rec", least_overlap=5)[1].collect()
    wanted = plain_links(rows, {0, 10, 20, 30}, least_overlap=5)
    assert {(r.class_id, r.query_id): (r.offset, pytest.approx(r.bit_error_rate)) for r in links} == wanted and len(wanted) > 20


def test_long_silence_is_one_run(spark):
    rows = [(k, [7] * (30_000 - k) + [k, k + 1]) for k in range(10)]
    started = time.monotonic()
    links = chroma.align(spark.createDataFrame(rows, "rec long, fingerprint array<int>"), F.lit(True), "rec")[1].collect()
    assert len(links) == 90 and time.monotonic() - started < 90


# -- the pipeline


def test_pipeline_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({c: F.lit("kept") for c in ("extra", "decoded", "__x", "score", "found", "id", "label")})
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SMALL).cache()
        assert set(docs.columns) <= set(out.columns) and (name == "encoding" or out.columns == docs.columns)
        assert out.where("decoded <> 'kept' OR extra <> 'kept' OR id <> 'kept'").count() == 0
        seen.append(out)
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen]
    before, good, single, clean, masked, coded = texts
    # quality: the model's own features, summed one by one
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    shares, bias = quality.fit(docs, labels)
    kept = set()
    for k, text in before.items():
        words = re.findall(r"[^ \t-\r]+", text or "")
        known = [quality.word_features([w]) for w in words]
        features = [f for buckets, *_ in known for f in buckets.tolist()]
        for i in range(len(words) - 1):
            shapes, hashes = (np.concatenate([known[i][j], known[i + 1][j]]) for j in (2, 3))
            features += quality.pair_buckets(shapes, hashes, np.array([0, int(words[i] != words[i + 1])]))[0].tolist()
        logit = (float(np.mean(shares[features])) if features else 0.0) + bias
        if 1 / (1 + np.exp(-logit)) >= corpus_pipeline.LEAST_QUALITY:
            kept.add(k)
    assert set(good) == kept and 0 < len(good) < len(before)
    # near duplicates: all pairs
    ids = sorted(good)
    _, roots = plain_groups([good[k] for k in ids], 5)
    assert set(single) == {ids[r] for r in set(roots)} | {k for k, r in zip(ids, roots) if ids[r] == k} and len(single) < len(good)
    # contamination: every item against every stretch of every text
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = set()
    for k, text in single.items():
        words = decontaminate.words_of(text)
        for item in items:
            most = int(0.2 * len(item) + 1e-9)
            if item and len(set(item) & set(words)) >= len(set(item)) - most and decontaminate.best_stretch(np.array([hash(w) for w in item]), np.array([hash(w) for w in words] or [0]))[0] <= most:
                held.add(k)
                break
    assert set(clean) == set(single) - held and held
    # personal data: base kinds by plain patterns
    assert set(masked) == set(clean) == set(coded)
    changed = 0
    for k, text in clean.items():
        spans = sorted((a, b, kind) for kind, a, b in brute_spans(text))
        if not spans:
            continue
        changed += 1
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        if not re.search(r"[A-Z]{2}[0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}", text):
            assert masked[k] == out + text[at:]
    assert changed
    library = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    for r in seen[-1].collect():
        assert list(r.ids) == library.encode(masked[r.doc_id]) and r.text == library.decode(list(r.ids)) and r.n_tokens == len(r.ids)


def test_pipeline_edges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, None, "en", "s", 0)], docs.schema))
    for frame in (odd, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SMALL)
        assert out.count() in (0, 3)


def test_pipeline_decides_each_row_by_itself(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    copy, other, own = "one two three four five six seven", "red green blue black white grey", "north south east west up down"
    rows = [(None, copy), (None, copy), (4, copy), (4, copy), (9, copy), (5, other), (5, own), (None, own), (7, own), (None, item), (6, item + " tail"), (6, "clean words only"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    order = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    single = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    assert single.columns == docs.columns
    left = order(single)
    assert [x for x in left if x[1] in (copy, other, own)] == sorted([(4, copy), (5, other), (5, own)], key=repr)
    assert (6, "clean words only") in left and (None, None) in left and (None, "") in left
    assert order(corpus_pipeline.decontamination_stage(spark, docs, SMALL)) == sorted([r for r in rows if r[1] not in (item, item + " tail")], key=repr)
