"""Near-duplicate groups of documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with equal sets form one class and are represented once; a class
has a number of its own, so ids may repeat or be null. Each tree of the join starts with all classes in one node. A node
chooses places of the minhash signature by a hash of its own, ``BRANCHES`` on average (1 / 0.8: of a pair at the threshold
one child goes on with both, on average), and its classes go on to one child for each chosen place, by their value there.
Nodes of at most ``SMALL_NODE`` classes are compared exhaustively: sketches first (the bound is ``SLACK`` standard errors
below the threshold), then the full sets of those that may have a link. Independent trees repeat this.

Two phases. First ``STAR_TREES`` trees go down ``STAR_LEVELS`` levels at once; their nodes are compared whole where small,
and otherwise cut into parts of bounded size that share one class of the node, the centre: work in proportion to the rows,
which already joins nearly all copies, large groups of near copies among them. Then ``TREES`` trees branch until their nodes are
small. A node whose classes all lie in one component can add nothing any more and is dropped. In a large group of near copies
branching multiplies the rows and hardly parts them, in every tree anew: large nodes of which one component has a third or
more end, and those of a component, of whatever trees, become one node. Such nodes, and those that are large after
``MOST_LEVELS`` levels, are compared in pairs of slices, but for pairs that lie within one component: no link is dropped.

Links are confirmed on the full sets, hashed to 64 bits anew from the texts of those documents that may have one. Those
texts are picked by a Bloom filter before they move; of a node only the connected parts of its possible links go on, and
the same part is confirmed once, however many trees have found it.

Defined results: documents without words or text have an empty set and are linked with nothing; those with fewer words
than a shingle have their whole sequence as the only one; each row is a document of its own: rows that repeat an id or
have none are grouped by their own texts, and a group's id is the least one in it (null if no row of it has one); an
empty table gives an empty result; very long texts are taken whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bloom import Level
from cadenza.llm.common import forget, materialize
from cadenza.llm.components import connected
from cadenza.llm.sentencepiece_codec import WordIndex, blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
PLACES, SMALL_NODE, SLACK, BRANCHES = 128, 200, 4.0, 1.25
STAR_TREES, STAR_LEVELS, TREES, STEP_LEVELS, MOST_LEVELS = 2, 3, 10, 4, 13
#: A large node ends where one component has this share; it is cut into about this many slices, of at most so many classes.
MAIN_SHARE, SLICES, MOST_SLICE = 1 / 3, 12, 500
CACHE_WORDS = 300_000
#: Keys that size the filter of wanted texts; with more it lets more other texts pass, which the join then drops.
MOST_FILTER_KEYS = 16_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, words_each: int):
        self.words_each = words_each
        self.reset()

    def reset(self) -> None:
        self.index, self.hashes = WordIndex(), np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.reset()
        lists = [WORD.findall(t.translate(UPPER)) if t else [] for t in texts]
        found = [np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) for words in lists]
        if self.index.new:
            fresh = [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in self.index.new]
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
            self.index.new = []
        return [self._set(self.hashes[at]) for at in found]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        n = min(self.words_each, len(words))
        code = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            code = mixed(code * PRIME + words[k : k + len(code)])
        return np.unique(code)


def signature_of(items: np.ndarray, places: int = PLACES, rows: int = 2048) -> np.ndarray:
    """Least value of each of ``places`` permutations of 32 bits of the hashes."""
    numbers = mixed(np.arange(1, 2 * places + 1, dtype=np.uint64) * PRIME).astype(np.uint32)
    salts, factors = numbers[:places], numbers[places:] | np.uint32(1)
    low = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    least = np.full(places, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), rows):
        np.minimum(least, ((low[a : a + rows, None] ^ salts) * factors).min(axis=0), out=least)
    return least


def key_of(items: np.ndarray) -> bytes | None:
    """Equal for equal sets: two independent sums of 64 bits, mixed with the size."""
    if not len(items):
        return None
    sums = np.array([items.sum(), mixed(items ^ PRIME).sum()], np.uint64)
    sums[0] ^= mixed(np.array([len(items)], np.uint64))[0]
    return sums.tobytes()


def describe(docs: DataFrame, words_each: int, places: int = PLACES) -> DataFrame:
    """id, text_hash, n_shingles, set_key (null for the empty set), signature and sketch, from (id, text).

    ``sketch`` has the low byte of each of the signature's values: enough to compare two classes (chance agreement only
    adds), a quarter as much to move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words_each)
        for batch in batches:
            for first, texts in blocks(batch, "text"):
                sets = shingler.sets(texts)
                signs = [signature_of(s, places) if len(s) else None for s in sets]
                full, short = ([None if s is None else s.astype(kind).tobytes() for s in signs] for kind in (np.uint32, np.uint8))
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("text_hash"), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(x, pa.binary()) for x in (list(map(key_of, sets)), full, short))],
                    names=["id", "text_hash", "n_shingles", "set_key", "signature", "sketch"],
                )

    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "id long, text_hash long, n_shingles long, set_key binary, signature binary, sketch binary")


def children(nodes: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of ``nodes`` (each held by row ``owner`` of ``signs``), and beside each the position of its parent."""
    chance, steps = mixed(nodes ^ np.uint64(0xA0761D6478BD642F)), np.arange(1, 9, dtype=np.uint64) * PRIME
    whole, part = int(BRANCHES), BRANCHES % 1
    found, above, seen = [], [], []
    for k in range(whole + (part > 0)):
        place = (mixed(nodes + steps[k]) % np.uint64(PLACES)).astype(np.int64)
        goes = np.ones(len(nodes), bool) if k < whole else (chance & np.uint64(0xFFFF)) < np.uint64(part * 65536)
        for other in seen:
            goes &= place != other
        seen.append(place)
        at = np.flatnonzero(goes)
        found.append(mixed(mixed(nodes[at] ^ place[at].astype(np.uint64)) * PRIME + signs[owner[at], place[at]]))
        above.append(at)
    return np.concatenate(found), np.concatenate(above)


def walked(starts: DataFrame, levels: int, last_only: bool = False) -> DataFrame:
    """(node, parent, step, cid, label) of the nodes up to ``levels`` below those in ``starts`` (cid, label, nodes, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("nodes")
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, PLACES)
            ends = np.asarray(lists.offsets)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            nodes = lists.flatten().to_numpy().view(np.uint64)
            for step in range(1, levels + 1):
                fresh, above = children(nodes, owner, signs)
                parents, nodes, owner = nodes[above], fresh, owner[above]
                if step == levels or not last_only:
                    take = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes.view(np.int64)), pa.array(parents.view(np.int64)), pa.array(np.full(len(nodes), step, np.int32)), batch.column("cid").take(take), batch.column("label").take(take)],
                        names=["node", "parent", "step", "cid", "label"],
                    )

    return starts.select("cid", "label", "nodes", "signature").mapInArrow(run, "node long, parent long, step int, cid long, label long")


def rooted(classes: DataFrame, first_tree: int, trees: int) -> DataFrame:
    """All classes at the roots of the trees."""
    seeds = mixed(np.arange(first_tree + 1, first_tree + trees + 1, dtype=np.uint64) * PRIME).view(np.int64).tolist()
    return classes.select("cid", "label", F.array(*map(F.lit, seeds)).alias("nodes"), "signature")


def sized(rows: DataFrame) -> DataFrame:
    """(node, parent, step, n, first) of the nodes with classes of more than one component; written, so that joins with it can be split where skewed.

    ``first``: the least hash of a class in the node.
    """
    ends = F.min("label").alias("low"), F.max("label").alias("high")
    counted = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("step").alias("step"), F.count("*").alias("n"), F.min(F.xxhash64("node", "cid")).alias("first"), *ends)
    return materialize(counted.where("low <> high").drop("low", "high"), "nodes")


def star_leaves(classes: DataFrame, first_tree: int, trees: int) -> DataFrame:
    """(node, cid, label): small nodes whole, larger ones in parts that share the node's class of the least hash."""
    rows = materialize(walked(rooted(classes, first_tree, trees), STAR_LEVELS, last_only=True), "paths")
    sizes = sized(rows)
    parts = F.ceil(F.col("n") / SMALL_NODE)
    own = F.when(F.xxhash64("node", "cid") == F.col("first"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), parts)))
    dealt = rows.join(sizes.select("node", "n", "first"), "node").select("node", "cid", "label", F.explode(own).alias("part"))
    out = materialize(dealt.select(F.xxhash64("node", "part").alias("node"), "cid", "label"), "leaves")
    forget(rows, sizes)
    return out


def sliced(rows: DataFrame) -> DataFrame:
    """Pairs of slices of large nodes (node, cid, label): all but those within one component.

    Components with more classes there than a slice have slices of their own; the rest are mixed. Slices grow with the node, so
    a class goes into a bounded number of pairs, up to nodes of ``SLICES * MOST_SLICE`` classes; beyond, pairs grow and tasks don't.
    """
    rows = rows.select("node", "cid", "label")
    own = materialize(rows.groupBy("node", "label").agg(F.count("*").alias("own")), "own")
    size = F.least(F.greatest(F.lit(SMALL_NODE // 2), F.ceil(F.sum("own") / SLICES)), F.lit(max(SMALL_NODE // 2, MOST_SLICE)))
    own = own.join(materialize(own.groupBy("node").agg(size.alias("half")), "halves"), "node")
    mixed_rows = materialize(own.where("own <= half").groupBy("node").agg(F.ceil(F.sum("own") / F.first("half")).alias("rest")), "rest")
    pure = own.where("own > half").select("node", "label", F.ceil(F.col("own") / F.col("half")).alias("pure"))
    pure = materialize(pure, "pure")
    named = rows.join(pure, ["node", "label"], "left").join(mixed_rows, "node", "left")
    number = F.when(F.col("pure").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("pure"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("rest")))
    kind = F.when(F.col("pure").isNotNull(), F.col("label"))
    named = named.select("node", "cid", "label", kind.alias("kind"), F.xxhash64("node", kind, number).alias("slice"))
    every = pure.select("node", F.col("label").alias("other_kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pure") - 1)).alias("number"))
    every = every.unionByName(mixed_rows.select("node", F.lit(None).cast("long").alias("other_kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).alias("number")))
    every = materialize(every.select("node", "other_kind", F.xxhash64("node", "other_kind", "number").alias("other")), "slices")
    met = materialize(named, "named").join(every, "node").where("kind IS NULL OR other_kind IS NULL OR kind <> other_kind")
    return met.select(F.xxhash64(F.least("slice", "other"), F.greatest("slice", "other")).alias("node"), "cid", "label")


def tree_leaves(classes: DataFrame, first_tree: int, trees: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, cid, label) of all nodes to compare exhaustively, and the written tables to delete once it has been used."""
    starts, depth, levels = rooted(classes, first_tree, trees), 0, 1
    found, united, written = [], [], []
    while True:
        rows = materialize(walked(starts, levels), "paths")
        depth += levels
        sizes = sized(rows)
        ends = sizes.where((F.col("n") <= SMALL_NODE) | (F.col("step") == levels))  # of large nodes above the last level nothing is kept
        wide = sizes.where(F.col("n") > SMALL_NODE).select(F.col("node").alias("parent"))
        ends = ends.where("step = 1").unionByName(ends.where("step > 1").join(wide, "parent", "left_semi"))  # below a small node nothing is to be done
        nodes = materialize(rows.join(ends.select("node", "n"), "node"), "nodes")
        forget(rows)
        written += [sizes, nodes]
        found.append(nodes.where(F.col("n") <= SMALL_NODE).select("node", "cid", "label"))
        large = nodes.where(F.col("n") > SMALL_NODE)
        own = large.groupBy("node", "label").agg(F.count("*").alias("own"), F.min("n").alias("n"))
        main = own.where(F.col("own") >= F.col("n") * MAIN_SHARE).groupBy("node").agg(F.max(F.struct("own", "label")).alias("main"))
        main = materialize(main.select("node", F.xxhash64(F.lit("main"), "main.label").alias("group")), "main")
        united.append(large.join(main, "node").select(F.col("group").alias("node"), "cid", "label"))
        written.append(main)
        large = large.join(main, "node", "left_anti")
        if large.isEmpty():
            break
        if depth >= MOST_LEVELS:
            united.append(large.select("node", "cid", "label"))
            break
        held = large.groupBy("cid").agg(F.min("label").alias("label"), F.collect_list("node").alias("nodes"))  # a class is in a bounded number of nodes
        starts, levels = held.join(classes.select("cid", "signature"), "cid"), STEP_LEVELS
    whole = united[0]
    for more in united[1:]:
        whole = whole.unionByName(more)
    whole = materialize(whole.distinct(), "united")
    written.append(whole)
    if not whole.isEmpty():
        found.append(sliced(whole))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return everything, written


def by_node(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each node, as a table; nodes are bounded, and many go through one task in sorted order."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            nodes = held.column("node").to_numpy()
            cuts = np.flatnonzero(nodes[1:] != nodes[:-1]) + 1
            if not len(cuts):
                continue
            yield from finished(held.slice(0, int(cuts[-1])), cuts[:-1])
            held = held.slice(int(cuts[-1]))
        if held is not None:
            yield from finished(held, np.zeros(0, np.int64))

    def finished(rows: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        marks = [0, *cuts.tolist(), rows.num_rows]
        columns = {n: rows.column(n).to_numpy(zero_copy_only=False) for n in rows.schema.names}
        out = [work({n: c[a:b] for n, c in columns.items()}) for a, b in zip(marks, marks[1:]) if b > a + 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(len(names))], names=names)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def likely(node: dict, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, cid, label: the connected parts of a node's possible links between components, by their sketches.

    A part is named by the classes that it holds, so that the same part of several trees has one name.
    """
    cids, first = np.unique(node["cid"], return_index=True)
    signs = np.frombuffer(b"".join(node["sketch"][first].tolist()), np.uint8).reshape(len(cids), -1)
    labels = node["label"][first]
    least = int(np.ceil(bound * PLACES))
    part = np.arange(len(cids))
    single = np.ones(len(cids), bool)
    for k in range(len(cids) - 1):
        other = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
        if len(other):
            hit = other[np.count_nonzero(signs[other] == signs[k], axis=1) >= least]
            if len(hit):
                single[hit] = single[k] = False
                old = np.unique(part[[k, *hit.tolist()]])
                part[np.isin(part, old)] = old[0]
    at = np.flatnonzero(~single)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    code = np.zeros(len(cids), np.uint64)
    np.add.at(code, part[at], mixed(cids[at].astype(np.uint64) * PRIME + np.uint64(1)))
    return code[part[at]].view(np.int64), cids[at], labels[at]


def spanning(node: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a node that join classes not yet joined, confirmed on the full sets: intersection * 100 >= union * percent."""
    ids, first = np.unique(node["cid"], return_index=True)
    sets = [np.frombuffer(node["items"][k], np.uint64) for k in first]
    labels = node["label"][first].copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = [], []
    flat = starts = present = None
    for k in range(len(ids) - 1):
        other = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
        other = other[np.minimum(sizes[other], sizes[k]) * 100 >= np.maximum(sizes[other], sizes[k]) * percent]
        if not len(other):
            continue
        if flat is None:
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            present = np.zeros(int(flat.max()) + 1, bool)
        own = flat[starts[k] : starts[k] + sizes[k]]
        present[own] = True
        if len(other) * 4 < len(ids):
            common = np.array([present[flat[starts[o] : starts[o] + sizes[o]]].sum() for o in other.tolist()])
        else:
            common = np.add.reduceat(present[flat].astype(np.int64), starts)[other]
        present[own] = False
        for o in other[common * 100 >= (sizes[other] + sizes[k] - common) * percent].tolist():
            if labels[o] != labels[k]:
                left.append(ids[k])
                right.append(ids[o])
                labels[labels == labels[o]] = labels[k]
    return np.array(left, np.int64), np.array(right, np.int64)


def links_of(docs: DataFrame, classes: DataFrame, leaves: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Confirmed spanning links (a, b) of the nodes, written."""
    t = percent / 100
    bound = t - SLACK * (t * (1 - t) / PLACES) ** 0.5
    signed = leaves.join(classes.select("cid", "sketch"), "cid")
    hopeful = materialize(by_node(signed, lambda n: likely(n, bound), "node long, cid long, label long").distinct(), "likely")
    wanted = materialize(hopeful.select("cid").distinct().join(classes.select("cid", "id", "text_hash", "set_key"), "cid"), "wanted")
    passed = Level(0, wanted.select(F.col("text_hash").alias("key")), min(wanted.count(), MOST_FILTER_KEYS))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).where(passed.hits(F.col("text_hash")))
    texts = texts.withColumnRenamed("id", "own").join(wanted, "text_hash").where("own <=> id").select("cid", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words_each)
        for batch in batches:
            for first, block in blocks(batch, "text"):
                sets = shingler.sets(block)
                same = [k for k, s in enumerate(sets) if key_of(s) == batch.column("set_key")[first + k].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column("cid").slice(first, len(block)).take(pa.array(same, pa.int64())), pa.array([sets[k].tobytes() for k in same], pa.binary())], names=["cid", "items"])

    sets = texts.mapInArrow(run, "cid long, items binary").dropDuplicates(["cid"])  # one of repeated rows
    out = materialize(by_node(hopeful.join(sets, "cid"), lambda n: spanning(n, percent), "a long, b long").distinct(), "links")
    forget(hopeful, wanted, passed.table)
    return out


def groups(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (id, text): id, n_shingles, component_id (the least id that links reach, its own included)."""
    docs = docs.select(F.col("id").cast("long").alias("id"), "text")
    described = materialize(describe(docs, words_each), "described")
    one_each = described.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash", "signature", "sketch")).alias("least"))
    classes = materialize(one_each.select(F.monotonically_increasing_id().alias("cid"), "set_key", "least.*").drop("unnamed"), "classes")
    narrow = materialize(described.select("id", "n_shingles", "set_key"), "sizes")
    forget(described)
    first = links_of(docs, classes.withColumn("label", F.col("cid")), leaves := star_leaves(classes.withColumn("label", F.col("cid")), 0, STAR_TREES), words_each, percent)
    forget(leaves)
    roots = connected(first)
    labelled = classes.join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root")
    leaves, written = tree_leaves(labelled, STAR_TREES, TREES)
    second = links_of(docs, classes, leaves, words_each, percent)
    forget(roots, *written)
    roots = connected(first.unionByName(second))
    linked = classes.select("cid", "set_key", "id").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = materialize(linked.join(least, "root").select("set_key", "component_id"), "named")
    forget(first, second, roots, classes, linked, least)
    joined = narrow.join(named.withColumn("grouped", F.lit(True)), "set_key", "left")
    return joined.select("id", "n_shingles", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
