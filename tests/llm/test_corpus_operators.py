"""Repeated passages, the filter audit and conversation repair against brute force; recall of the benchmark's keys."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import conversations, decontaminate, filter_audit, repeats
from cadenza.llm.run_index import RunIndex
from tests.llm.test_text_operators import edited

# -- 11


def test_index_marks_what_started_earlier():
    rng = random.Random(1)
    for _ in range(300):
        least = rng.choice([3, 5, 8, 9, 17])
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = [base[(a := rng.randint(0, 50)) : a + rng.randint(1, 40)] if rng.random() < 0.5 else bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        index = RunIndex(strings)
        got, seen, place = index.repeated(least, block=7), set(), 0
        for s in strings:
            for i in range(len(s) + 1):
                window = s[i : i + least]
                assert got[place] == (len(window) == least and window in seen)
                seen |= {window} if len(window) == least else set()
                place += 1
        assert index.runs <= len(index.text)


def test_matching_statistics_come_from_the_samples():
    strings = [b"banana bandana", b"bandana banana", b"anaban"] * 2
    index = RunIndex(strings)
    text, rest = index.text.tobytes(), index.rest
    near, shared = index.statistics(0, len(text))
    suffixes = sorted(range(len(text)), key=lambda p: (text[p : p + rest[p]] + b"\xff", p))
    for above, p in itertools.pairwise(suffixes):
        n = 0
        while n < min(rest[p], rest[above]) and text[p + n] == text[above + n]:
            n += 1
        assert shared[p] == n and (near[p] == above or n == 0)
    assert index.runs < len(text)


def cut_by_hand(rows, least):
    """Of (id, text) rows, by id, nulls last, then by the hash that orders rows of one id: (bytes, removed, spans, kept)."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        covered = [False] * len(data)
        for p in range(len(data) - least + 1):
            if data[p : p + least] in seen:
                covered[p : p + least] = [True] * least
            seen.add(data[p : p + least])
        spans = [(a := list(g))[0][0] and (a[0][0], len(a)) or (0, len(a)) for c, g in itertools.groupby(enumerate(covered), lambda x: x[1]) if c]
        out[key] = (len(data), sum(covered), spans, bytes(b for b, c in zip(data, covered, strict=True) if not c))
    return out


def corpus(least, seed=3):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 3 * least))) for _ in range(12)]
    rows = [(i * 7 % 151, "".join(rng.choice([rng.choice(lines), "".join(rng.choice("abc") for _ in range(rng.randint(1, least)))]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    return rows + [(500, None), (501, ""), (502, "a" * 5000), (503, "ab" * 3000), (504, rows[3][1]), (505, rows[3][1]), (506, "a" * 3000 + "b")]


def found(df, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.find(df, **options).collect()}


@pytest.mark.parametrize(("least", "hot_count"), [(20, 256), (100, 256), (100, 2), (20, 2), (7, 2)])
def test_repeats_equal_brute_force(spark, least, hot_count, monkeypatch):
    rows = corpus(least)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("at", "tie", "data", "parts", "n_bytes", "kept")})
    wanted = cut_by_hand(sorted(rows), least)
    assert found(df.repartition(3), least=least, hot_share=1, hot_count=hot_count) == wanted
    if hot_count == 2:
        assert found(df.coalesce(1), least=least, hot_share=1, hot_count=hot_count) == wanted
    else:
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 300)
        assert found(df.repartition(2), least=least) == wanted


def test_copies_of_whole_texts_are_removed_before_they_are_cut(spark, monkeypatch):
    long = "".join(f"{k} " for k in range(9000))  # more windows than a run may have
    assert len(long) > repeats.MOST_RUN
    rows = [(1, "x" * 19), (2, long), (3, "x" * 19), (4, long), (5, long + "."), (6, "abcdefghij" * 2), (7, "abcdefghij" * 2), (8, None), (4, long)]
    seen = []
    cut = repeats.stretches
    monkeypatch.setattr(repeats, "stretches", lambda texts, *rest: (seen.append(texts.where("octet_length(data) >= 20").count()), cut(texts, *rest))[1])
    got = sorted(tuple(r) for r in repeats.find(spark.createDataFrame(rows, "doc_id long, text string"), least=20).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "length(kept)").collect())
    n = len(long)
    assert got == [(1, 19, 0, 0, 19), (2, n, 0, 0, n), (3, 19, 0, 0, 19), (4, n, n, 1, 0), (4, n, n, 1, 0), (5, n + 1, n, 1, 1), (6, 20, 0, 0, 20), (7, 20, 20, 1, 0), (8, 0, 0, 0, 0)]
    assert seen == [3]


def test_pieces_that_cannot_share_a_window_reach_no_index(monkeypatch):
    rng = np.random.default_rng(8)
    made = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    anchor, same = made(24), made(60)
    route = int(repeats.piece_hashes(np.frombuffer(anchor, np.uint8), 24).view(np.int64)[0])
    apart = [made(60) + anchor + made(60) for _ in range(50)]
    left, right = [made(5) + same + anchor + made(60) for _ in range(2)], [made(60) + anchor + same + made(5) for _ in range(2)]
    twice = made(40) + same + anchor + same + anchor + made(40)
    window = made(100)  # of a frequent anchor, under a hash of its own
    rows = [(route, p) for p in sorted([*apart, *left, *right])] + [(route + 1, twice), (route + 2, b""), (route + 3, made(100)), (route + 4, window), (route + 4, window)]
    columns = {"route": [r for r, _ in rows], "at": range(len(rows)), "tie": [0] * len(rows), "place": [0] * len(rows), "piece": [p for _, p in rows]}
    table = pa.table({k: pa.array(v, pa.binary() if k == "piece" else pa.int64()) for k, v in columns.items()})
    for seen, most in ((1, 1), (1, 7), (1 << 20, 1000)):
        monkeypatch.setattr(repeats, "SEEN_BYTES", seen)
        found = [(r[0], r[4]) for r in repeats.candidates(iter(table.to_batches(max_chunksize=most)), 100)]
        assert found == [x for x in rows if x[1] in {*left, *right, b"", window}]
    data = twice.replace(anchor, made(24))  # the anchor of its own stretch, twice in it
    hashes = repeats.piece_hashes(np.frombuffer(data, np.uint8), 24)
    assert repeats.may_share(hashes[[100]].view(np.int64), np.frombuffer(data, np.uint8), np.array([len(data)]), 100).tolist() == [True]


def test_anchors_that_are_twice_in_a_stretch():
    rng = np.random.default_rng(9)
    for least in (20, 100):
        sizes = np.array([0, 5, 700, least, 1300, least - 1, 0, 900])
        data = rng.integers(97, 99, sizes.sum(), dtype=np.uint8)
        data[300:600] = np.tile(data[300:330], 10)
        hashes, size = repeats.piece_hashes(data, repeats.piece_size(least)), repeats.piece_size(least)
        place, windows, anchor, inner = repeats.cut(data, sizes, least)
        spans = [hashes[p : p + w + least - size] for p, w in zip(place, windows)]
        assert [(x == a).sum() > 1 for x, a in zip(spans, anchor)] == inner.tolist() and inner.any() and not inner.all()
        assert all(x.min() == a for x, a in zip(spans, anchor)) and windows.sum() == np.maximum(sizes - least + 1, 0).sum()


def test_repeats_of_rows_without_or_with_equal_ids(spark):
    text, other = "x" * 30 + "0123456789" * 5, "y" + "0123456789" * 5
    rows = [(1, text), (1, text), (2, other), (None, text), (None, other), (None, other), (2, "z" * 60)]
    got = [tuple(r) for r in repeats.find(spark.createDataFrame(rows, "doc_id long, text string"), least=20).select("doc_id", "n_bytes", "n_removed").collect()]
    # rows equal in id and text are one document; the ends of the first text repeat themselves
    first = cut_by_hand([(1, text)], 20)[1][1]
    assert sorted(g[1:] for g in got if g[0] == 1) == [(80, first)] * 2
    assert sorted(g[1:] for g in got if g[0] is None) == [(51, 51), (51, 51), (80, 80)]
    assert sorted(g[1:] for g in got if g[0] == 2) == [(51, 50), (60, 59)]
    assert repeats.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- 12


def audited(docs, labels):
    first, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 200) * "A" + (100 * len(set(words)) < 50 * len(words)) * "B" + (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) * "C" + bool(re.search(r"[#$%&*|]", t)) * "D" + (i is not None and i > first[t]) * "E"
        rows.append((part or "", fails, any(q == 1 for j, q, _ in labels if j == i), any(x == 1 for j, _, x in labels if j == i)))
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(f in r[0] for r in own) - len(removed), sum(r[0] == f for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    makers = [lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 250]))), lambda: "same " * rng.choice([5, 260]), lambda: "LOUD TEXT " * 30, lambda: "cost $5 | " + "x" * 9, lambda: None, lambda: "", lambda: "Ünï \x0b\x1cç É"]
    docs = [(i, rng.choice(makers)(), rng.choice(["a", "b", None, "", "c"])) for i in range(300)]
    docs += [(300 + i, docs[i % 7][1], "copies") for i in range(40)] + [(None, docs[0][1], "a"), (0, docs[0][1], "a"), (900, "W " * 40_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 340, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "digest", "fails", "first", "good", "id", "filter")}).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    wanted = audited(docs, [x for x in labels if x[0] is not None])
    for rows in (filter_audit.BLOCK_ROWS, 13):
        monkeypatch.setattr(filter_audit, "BLOCK_ROWS", rows)
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(df, marks).collect()}
        assert got == wanted
    assert filter_audit.audit(df.where("false"), marks).collect() == []


# -- 13


def damaged_by_hand(rows):
    out = {}
    for key, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(key, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in out.items()}


def repaired_by_hand(turns):
    """Least (cost, letters) by search over (turn, state)."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in turns]
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0", ())], set()
    while True:
        cost, letters, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in "0a":
            break
        other, name = ("a", "assistant") if state == "u" else ("u", "user")
        heapq.heappush(heap, (cost + 2, letters + "I", at, other, (*out, (name, ""))))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, state, out))
            if faults[at] in ("", "truncated"):
                more = faults[at] != ""
                if (state, initials[at]) in after:
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, after[state, initials[at]], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, other, (*out, (name, text))))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def talks(seed=2):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Sys", "adm"], ["Hi.", "Ok!", "no end", "", None, " \n", "q? ", "x", "é. "]
    rows = []
    for c in range(400):
        good = rng.random() < 0.5
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            turn = None if rng.random() < 0.03 else rng.randint(0, 12) if rng.random() < 0.2 else t
            rows.append((c, turn, ["user", "assistant"][t % 2] if good and rng.random() < 0.9 else rng.choice(roles), f"t{t}." if rng.random() < 0.7 else rng.choice(texts)))
    rows += [(None, 1, "user", "a."), (None, 2, None, None), (None, None, None, None)]
    rows += [(9000, t, rng.choice(roles[:4]), f"t{t % 700}" + rng.choice([".", ""])) for t in range(1200)]
    return rows + [(9001, t, rng.choice(roles[:2]), f"t{t}.") for t in range(1600)] + [(9002, 1, "user", "word " * 200_000 + ".")]


def test_repair_equals_search(spark):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("fault", "initial", "cost", "copy", "gone", "again")}).repartition(3)
    wanted = {k: repaired_by_hand(v) for k, v in damaged_by_hand(rows).items()}
    for held in (conversations.HELD_BYTES, 100):  # 100: longer conversations by way of a scratch file
        assert {r[0]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df), held_bytes=held).collect()} == wanted
        turns = {}
        for r in sorted(conversations.repair(conversations.damaged(df), as_turns=True, held_bytes=held).collect(), key=lambda r: r.place):
            turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {k: hashlib.sha256("\n".join(turns.get(k, [])).encode()).hexdigest() for k in wanted} == {k: v[-1] for k, v in wanted.items()}
    assert conversations.repair(conversations.damaged(df.where("false"))).collect() == []


def test_blocks_of_a_conversation_compose(monkeypatch):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 60, 80)
    initial, fault = rng.choice([0, 1, 2, 2, 3, 3], sizes.sum()), rng.choice([0, 0, 0, 1, 2, 3], sizes.sum())
    starts = np.cumsum(sizes) - sizes
    whole = conversations.solve(initial, fault, starts)
    for block in (1, 4, 7):
        monkeypatch.setattr(conversations, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(conversations.solve(initial, fault, starts), whole, strict=True))


# -- 1


@pytest.mark.parametrize("n", [1, 12, 38, 59, 100, 150, 200, 300])
def test_keys_alone_find_edited_passages_of_any_length(n):
    rng = random.Random(n)
    pool = [f"w{k}" for k in range(3000)]
    items = [(k, rng.choices(pool, k=n)) for k in range(10)]
    docs = [[*rng.choices(pool, k=20), *edited(items[k % 10][1], int(0.2 * n + 1e-9), rng, pool, k % 2), *rng.choices(pool, k=20)] for k in range(100)]
    finder = decontaminate.Finder(items, 0.8, exact=False)
    hits = {(d, i) for d, i, *_ in finder.find(docs)}
    assert sum((k, k % 10) in hits for k in range(100)) >= 97
    exact = {(d, i) for d, i, *_ in decontaminate.Finder(items, 0.8).find(docs)}
    assert hits <= exact
    finder._keyed = lambda *_: None  # no window shares a key: nothing is verified
    assert finder.find(docs) == []


def test_a_key_may_not_be_named_as_a_result(spark):
    with pytest.raises(ValueError):
        decontaminate.find_items(spark.createDataFrame([(1, "a")], "distance long, text string"), spark.createDataFrame([], "item_id long, text string"), key="distance")


# -- 9


def test_trees_alone_give_the_same_groups(spark):
    """Without the star phase the chosen-path trees find the same components."""
    from cadenza.llm import near_dedup
    from cadenza.llm.common import materialize
    from cadenza.llm.components import connected

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    described = near_dedup.describe(docs, 5)
    one_each = described.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct("id", "text_hash", "signature", "sketch")).alias("least"))
    classes = materialize(one_each.select(F.col("least.id").alias("cid"), "set_key", "least.*"), "classes").withColumn("label", F.col("cid"))
    links = near_dedup.links_of(docs, classes, near_dedup.tree_leaves(classes, 0, near_dedup.TREES)[0], 5, 80)
    roots = {r.id: r.root for r in connected(links).collect()}
    whole = {r.id: r.component_id for r in near_dedup.groups(docs).collect()}
    own = {r.set_key: r.cid for r in classes.select("set_key", "cid").collect()}
    mine = {r.id: roots.get(own.get(r.set_key, r.id), own.get(r.set_key, r.id)) for r in described.select("id", "set_key").collect()}
    assert mine == whole and links.count() > 2
